"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector;
its hash is the signed axis it then points to most. Each table joins one or more such hashes. Every
row is indexed once per table; a query also looks into the buckets of its next-best axes, and all that
it meets is scored exactly.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank.plans.sizing import durable, small

TABLES, PROBES, HASHES, SEED = 10, 10, 1, 7
# Vectors and queries of one bucket that meet in one task; larger buckets are cut into tiles.
TILE_ROWS, TILE_QUERIES = 16_384, 2_048
# Unequal norms: rows are hashed in bands of norms this factor wide, and the longest share of all rows meets every query.
BAND, LONGEST = 1.1, 1 / 32
_LONG_BUCKET = -1
_SLICE = 256


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows, scaled to keep their length."""
    rows, size = x.shape
    step = 1
    while step < size:
        x = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(rows, size) / np.sqrt(size)


def signs(size, tables, hashes, seed):
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, size))


def rotated(x, rounds):
    """The rows of ``x`` after three rounds of signs and transform."""
    for flip in rounds:
        x = hadamard(x * flip)
    return x


def axes(turned, probes):
    """The ``probes`` best signed axes of each row and what each loses against the best."""
    size = turned.shape[1]
    order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(turned, order, axis=1)
    code = order + np.where(value < 0, size, 0)
    return code, (np.abs(value[:, :1]) - np.abs(value)) ** 2


def buckets(unit, flips, probes):
    """Bucket numbers of each row, per table the ``probes`` with the least loss: (rows, tables × probes)."""
    tables, hashes, _, size = flips.shape
    rows, out = len(unit), []
    for table in range(tables):
        codes, loss = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for flip in flips[table]:
            code, more = axes(rotated(unit, flip), probes)
            codes = (codes[:, :, None] * (2 * size) + code[:, None, :]).reshape(rows, -1)
            loss = (loss[:, :, None] + more[:, None, :]).reshape(rows, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            codes, loss = np.take_along_axis(codes, best, axis=1), np.take_along_axis(loss, best, axis=1)
        out.append(codes * tables + table)
    return np.concatenate(out, axis=1)


def matrix(column, size):
    """A list column without nulls as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def banded(x, norms, width):
    """Unit rows whose added coordinate is what each norm lacks to the top of its own band.

    Bands end at the powers of ``BAND``, so no row changes how rows of other norms are hashed. Within a band the
    nearest direction is the largest inner product but for the factor of the band.
    """
    place = np.log(norms) / np.log(BAND)
    share = BAND ** (place - np.floor(place) - 1)
    unit = np.zeros((len(x), width))
    unit[:, : x.shape[1]] = x * (share / norms)[:, None]
    unit[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - share**2))
    return unit


def _hasher(size, long, equal_norms, tables, hashes, probes, seed, query):
    """Arrow batches of (id, vector) to (bucket, id, vector), one row per bucket looked into.

    Of unequal norms, rows longer than ``long`` and all queries also go to a bucket of their own.
    """

    def hashed(batches):
        width = 1 << (size + (not equal_norms) - 1).bit_length() if size > 1 or not equal_norms else 1
        flips = signs(width, tables, hashes, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE * 8):
                part = batch.slice(start, _SLICE * 8)
                x = matrix(part.column(1), size)
                norms = np.linalg.norm(x, axis=1)
                if query or equal_norms:
                    unit = np.zeros((len(x), width))
                    unit[:, :size] = x / norms[:, None]
                else:
                    unit = banded(x, norms, width)
                found = buckets(unit, flips, probes if query else 1)
                rows, codes = np.repeat(np.arange(len(x)), found.shape[1]), found.ravel()
                if not equal_norms:
                    more = np.arange(len(x)) if query else np.flatnonzero(norms > long)
                    rows, codes = np.append(rows, more), np.append(codes, np.full(len(more), _LONG_BUCKET))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(codes), *taken.columns], ["bucket", "id", "vector"])

    return hashed


def best_of(query_ids, queries, ids, vectors, k):
    """The k other ids with the largest inner products for each query: (query, id, score), ties to smaller ids.

    An id with several vectors counts once, by its largest product. A matrix product picks the rows, the
    scores of the picked are summed in one fixed order.
    """
    out = [[], [], []]
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    for start in range(0, len(queries), _SLICE):
        block = slice(start, start + _SLICE)
        rough = queries[block] @ vectors.T
        rough[query_ids[block][:, None] == ids[None, :]] = -np.inf
        if len(starts) > k:
            by_id = np.maximum.reduceat(rough, starts, axis=1) if len(starts) < len(ids) else rough
            limit = -np.partition(-by_id, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * np.maximum(1.0, np.abs(limit))
            picked = (rough >= (limit - slack)[:, None]) & (rough > -np.inf)
        else:
            picked = rough > -np.inf
        row, column = np.nonzero(picked)
        score = np.einsum("ij,ij->i", queries[block][row], vectors[column])
        order = np.lexsort((-score, ids[column], row))
        row, column, score = row[order], column[order], score[order]
        if row.size:
            once = np.append(True, (np.diff(row) != 0) | (np.diff(ids[column]) != 0))
            row, column, score = row[once], column[once], score[once]
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        first = np.searchsorted(row, row, side="left")
        keep = np.arange(row.size) - first < k
        out[0].append(query_ids[block][row[keep]])
        out[1].append(ids[column[keep]])
        out[2].append(score[keep])
    return [np.concatenate(o) if o else np.empty(0) for o in out]


_FOUND = "query_id bigint, vec_id bigint, score double"


def _meeting(size, k):
    """The indexed rows and the queries of one tile to the tile's best hits."""

    def meet(index, queries):
        names = ["query_id", "vec_id", "score"]
        if not index.num_rows or not queries.num_rows:
            empty = [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names)
        read = [
            (t.column("id").to_numpy(), matrix(t.column("vector").combine_chunks(), size)) for t in (queries, index)
        ]
        return pa.Table.from_arrays([pa.array(c) for c in best_of(*read[0], *read[1], k)], names)

    return meet


def _scanner(query_ids, queries, size, k):
    """Arrow batches of (id, vector) to each batch's best hits for a block of queries."""

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                found = best_of(query_ids, queries, batch.column(0).to_numpy(), matrix(batch.column(1), size), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return scan


def _ranked(hits, k):
    """The k best of each query; an id found in several tables or by several vectors counts once, by its best score."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k)


def nearest(
    rows, is_query, k=20, id_col="vec_id", vector_col="embedding", tables=TABLES, probes=PROBES, hashes=HASHES,
    seed=SEED, tile_rows=TILE_ROWS, tile_queries=TILE_QUERIES,
):
    """The k rows with the largest inner product found for each row for which ``is_query`` holds.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the inner product in double precision
    of the vectors as given. Ties go to the smaller id. A row never finds its own id. All rows are
    indexed. Rows with a null id, and null, empty or zero vectors or vectors with a null or
    non-finite component take no part, nor do vectors of another length than the most common
    one (the longer of two equally common). Repeated rows (same id and vector) count once, and ask if one of
    them does. An id with several vectors keeps them all: it takes one place, with the largest score of any
    pair of its vectors and the query's. A query that the tables give fewer than k ids is
    compared with all rows, so that only fewer candidates than k leave fewer rows.

    Vectors of unequal norm get one more coordinate for hashing (the norm missing to the top of a band of norms a
    factor of ``BAND`` wide); a query looks into the same buckets for all bands, and the rows longer than all but
    ``LONGEST`` of the table are compared with every query, as their inner products are large in any direction.
    ``tables``, ``probes`` and ``hashes`` (axes per bucket) trade work for recall; a bucket holds about one in
    (2 × dimensions)^hashes rows. Buckets are cut into tiles of at most about ``tile_rows`` rows and
    ``tile_queries`` queries, so a vector that is very common is no larger task than others.
    """
    spark = rows.sparkSession
    named = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), is_query.alias("asks")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = named.dropna(subset=["id", "vector"]).filter(sound & F.exists("vector", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shapes = valid.groupBy(F.size("vector").alias("size")).agg(
        F.count("*").alias("n"), F.min(norm).alias("least"), F.max(norm).alias("most"),
        F.percentile_approx(norm, 1 - LONGEST).alias("long"),
    )
    shape = shapes.orderBy(F.desc("n"), F.desc("size")).first()
    if shape is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, equal = shape["size"], shape["least"] >= shape["most"] * (1 - 1e-4)
    # Repeated rows would fill buckets and places; the groups are combined before they are shuffled.
    valid = valid.filter(F.size("vector") == size).groupBy("id", "vector").agg(F.max("asks").alias("asks"))
    valid = durable(valid, "vectors")
    plain, asking = valid.select("id", "vector"), valid.filter("asks").select("id", "vector")
    kind = valid.schema["vector"].dataType.simpleString()

    def placed(df, query):
        looked = probes if equal else probes * 5 // 2  # the added coordinate brings more axes
        hasher = _hasher(size, shape["long"], equal, tables, hashes, looked, seed, query)
        return df.mapInArrow(hasher, f"bucket bigint, id bigint, vector {kind}")

    index, asked = placed(plain, False), placed(asking, True)
    counts = index.groupBy("bucket").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts")).join(
        asked.groupBy("bucket").agg(F.ceil(F.count("*") / tile_queries).cast("int").alias("query_parts")), "bucket"
    )
    counts = durable(counts, "tiles")

    def dealt(df, own, other):
        names = {"parts": "part", "query_parts": "query_part"}
        own_part = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(names[own])
        others = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[other])
        return df.join(small(counts), "bucket").select("bucket", "id", "vector", own_part, others)

    key = ["bucket", "part", "query_part"]
    left = dealt(index, "parts", "query_parts").groupBy(*key)
    right = dealt(asked, "query_parts", "parts").groupBy(*key)
    found = durable(_ranked(left.cogroup(right).applyInArrow(_meeting(size, k), _FOUND), k), "hits")

    enough = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = durable(asking.join(enough, "id", "left_anti"), "short")
    blocks = -(-short.count() // tile_queries)
    extra = None
    for number in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).collect()
        if block:
            ids = np.array([r["id"] for r in block], np.int64)
            asked_block = np.array([r["vector"] for r in block], np.float64).reshape(-1, size)
            hits = plain.mapInArrow(_scanner(ids, asked_block, size, k), _FOUND)
            extra = hits if extra is None else extra.union(hits)
    if extra is not None:
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(
            "query_id", "vec_id", "score", "rank"
        ).union(_ranked(extra, k).select("query_id", "vec_id", "score", "rank"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
