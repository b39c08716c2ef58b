"""Exact nearest passages for many sub-queries at once.

Two physical forms give the same rows. Few sub-queries fit a broadcast: every task scans its passages once, in place,
keeping its best k per sub-query, so passages are not shuffled; more of them go in groups of that size. Many
sub-queries are dealt out in blocks of bounded size instead, and every block's task sees the passages pass by
in the order of their ids, read in place from where they are stored once: its best k are final, and no hits of
different tasks have to be merged. What is moved and written grows with the input, only the pairs grow with its square.

A scan whose tasks would give out very many hits is preceded by a slice of a fixed number of tasks:
the k-th distance found there is an upper bound of the final one, and tasks that know it give out
only few of the pairs that they would otherwise all have to send as their best k.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.fixed_values import DEFAULT_HITS, HITS_PER_QUERY
from passarank.functions.scores import DISTANCE_DIGITS
from passarank.plans.prefix import numbered
from passarank.plans.sizing import BROADCAST_BYTES, durable, input_bytes, measured_bytes, small
from passarank.plans.stored import Ordered
from passarank.sources.collections import within

QUERY = ["request_id", "query_idx"]
BROADCAST_QUERIES = 8192
# Sub-queries of a block, fewer if a task would hold more than so many hits, and the fewest that blocks are cut down to
# for the sake of idle cores.
QUERY_BLOCK = 8192
HELD_HITS = 1 << 21
LEAST_BLOCK = 64
# Passages that a task knows before it forgets those that are in no hit.
PASSAGE_BLOCK = 131_072
# Pairs that wait at least before they are cut back.
CELLS = 1 << 20
# Similarities worked out at once, sub-queries x passages: a tile of single precision that stays in a core's cache. Where
# more than one in so many of a tile's pairs may count, its exact similarities are worked out as a whole.
TILE_QUERIES, TILE_PASSAGES = 1024, 256
DENSE = 32
# Distances from which on the work should keep all cores busy; and bytes that a hit takes while hits are merged.
MANY_PAIRS = 1 << 26
HIT_BYTES = 64
# With candidates, scans of the passages that cost about as much as moving each of them to the blocks of its entity.
SCANS = 16
# Hits given out by all tasks from which on bounds come first, and hits are merged in steps.
MANY_HITS = 50_000_000
MERGE_FAN = 64
# Tasks whose passages give the bounds.
SLICE_TASKS = 64
# Distances are whole numbers of rounding steps, from 0 to twice this.
STEPS = 10**DISTANCE_DIGITS
STEP_BITS = (2 * STEPS).bit_length()


def unit_rows(vectors):
    """Arrow list column as a matrix with rows of length one; a zero row stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(vectors):
        return flat.reshape(0, 0)
    sizes = pc.min_max(pc.list_value_length(vectors)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of {sizes['min']} and of {sizes['max']} values in one column")
    if not np.isfinite(flat).all():
        raise ValueError("a vector with a missing or non-finite component")
    matrix = flat.reshape(len(vectors), -1)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length > 0, length, 1.0)


class Nearest:
    """The k nearest passages per sub-query among those offered so far, ties by passage id.

    Passages are offered in the order of their ids. A pair is one number: sub-query, distance in rounding
    steps and place of the passage among those held, so that sorting the numbers puts the pairs in order. Pairs behind a
    sub-query's k-th are dropped at once; the rest wait in a buffer that is cut back to k per sub-query
    whenever it has grown as large as what is kept.
    """

    def __init__(self, queries, k, bound=None):
        self.k, self.queries = k, queries
        self.row_bits = 64 - STEP_BITS - max(queries - 1, 1).bit_length()
        self.pair_bits = STEP_BITS + self.row_bits
        self.last = np.full(queries, (1 << self.pair_bits) - 1, np.uint64)  # the largest distance and place still of use
        self.least = np.full(queries, -np.inf)  # and the similarity below which nothing is
        if bound is not None:
            known = np.flatnonzero(np.isfinite(bound))
            step = np.rint(bound[known] * STEPS).astype(np.uint64)
            self.limit(known, ((step + np.uint64(1)) << np.uint64(self.row_bits)) - np.uint64(1))
        self.codes = np.empty(0, np.uint64)
        self.waiting, self.n_waiting = [], 0
        self.rows, self.n_rows, self.most_rows = [], 0, PASSAGE_BLOCK

    def limit(self, query, last):
        """From now on only pairs up to ``last`` count."""
        self.last[query] = last
        step = (last >> np.uint64(self.row_bits)).astype(np.float64)
        self.least[query] = 1.0 - (step + 0.5) / STEPS - 1e-9

    def hold(self, table):
        """Keep the columns of some more passages; returns the place of the first."""
        if self.n_rows > self.most_rows:
            self.forget()
        first = self.n_rows
        if first + table.num_rows >= 1 << self.row_bits:
            raise ValueError(f"{self.queries} sub-queries with {self.k} hits each are too many for one task")
        self.rows.append(table)
        self.n_rows += table.num_rows
        return first

    def add(self, at, query, similarity):
        """Offer pairs: the places of passages, the numbers of sub-queries and their similarities."""
        steps = np.rint((1.0 - similarity) * STEPS)
        codes = (np.maximum(steps, 0.0).astype(np.uint64) << np.uint64(self.row_bits)) | at.astype(np.uint64)
        ahead = codes <= self.last[query]
        codes = codes[ahead] | (query[ahead].astype(np.uint64) << np.uint64(self.pair_bits))
        self.waiting.append(codes)
        self.n_waiting += len(codes)
        if self.n_waiting > max(self.k * self.queries, CELLS // 8):
            self.cut()

    def cut(self):
        """Keep the first k pairs of each sub-query in the order (distance, passage id)."""
        if self.waiting:
            self.codes = np.concatenate([self.codes, *self.waiting])
            self.waiting, self.n_waiting = [], 0
            self.codes.sort()
        place = self.places()
        self.codes = self.codes[place < self.k]
        full = self.codes[place[place < self.k] == self.k - 1]
        # Of later pairs only those before the k-th count.
        query = (full >> np.uint64(self.pair_bits)).astype(np.int64)
        self.limit(query, (full & np.uint64((1 << self.pair_bits) - 1)) - np.uint64(1))

    def places(self):
        """The place of every kept pair among those of its sub-query, from 0."""
        query = self.codes >> np.uint64(self.pair_bits)
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        return np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))

    def forget(self):
        """Drop the passages that are in no pair; the others keep their order."""
        self.cut()
        row = self.codes & np.uint64((1 << self.row_bits) - 1)
        used, now = np.unique(row, return_inverse=True)
        self.codes = self.codes - row + now.astype(np.uint64)
        self.rows = [pa.concat_tables(self.rows).take(pa.array(used.astype(np.int64)))] if len(used) else []
        self.n_rows, self.most_rows = len(used), max(PASSAGE_BLOCK, 2 * len(used))
        self.cut()

    def hits(self, query_rows, size=65_536):
        """Hits as tables of bounded size: sub-query columns, passage columns, distance and place from 1."""
        self.cut()
        if not len(self.codes):
            return
        table, places = pa.concat_tables(self.rows).combine_chunks(), self.places()
        for start in range(0, len(self.codes), size):
            codes = self.codes[start : start + size]
            step = (codes & np.uint64((1 << self.pair_bits) - 1)) >> np.uint64(self.row_bits)
            left = query_rows.take(pa.array((codes >> np.uint64(self.pair_bits)).astype(np.int64)))
            right = table.take(pa.array((codes & np.uint64((1 << self.row_bits) - 1)).astype(np.int64)))
            columns = [*left.columns, *right.columns, pa.array(step.astype(np.float64) / STEPS), pa.array((places[start : start + size] + 1).astype(np.int32))]
            yield pa.table(columns, names=[*left.column_names, *right.column_names, "distance", "pos"])

    def result(self, query_rows):
        """All hits as one table, None if there are none."""
        tables = list(self.hits(query_rows))
        return pa.concat_tables(tables) if tables else None


def _offer(nearest, table, embedding, matrix, allowed):
    """Offer all rows of a table."""
    if not len(matrix) or not table.num_rows:
        return
    ids = table["passage_id"].combine_chunks()
    if ids.null_count or not pc.all(pc.less_equal(ids[:-1], ids[1:]), min_count=0).as_py():
        table = table.take(pc.sort_indices(ids, null_placement="at_start"))
    held = table.drop_columns([embedding])
    vectors = unit_rows(table[embedding])
    at = nearest.hold(held) + np.arange(len(vectors))
    if allowed is None:
        _tiles(nearest, at, vectors, np.arange(len(matrix)), matrix)
        return
    coded = pc.dictionary_encode(held["entity_id"].combine_chunks())
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    by_code = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[by_code], np.arange(len(coded.dictionary) + 1))
    for code, entity in enumerate(coded.dictionary.to_pylist()):
        requests = allowed[0].get(entity)
        if requests is not None:
            numbers = np.sort(np.concatenate([allowed[1][r] for r in requests]))
            chosen = by_code[edges[code] : edges[code + 1]]
            _tiles(nearest, at[chosen], vectors[chosen], numbers, matrix)


def _tiles(nearest, at, vectors, numbers, matrix):
    """Offer passages to the sub-queries ``numbers``, which are rows of ``matrix``.

    Similarities of single precision only tell which pairs surely do not count. Those of the others are worked out
    in double precision.
    """
    rough_vectors = vectors.astype(np.float32)
    slack = (vectors.shape[1] + 8) * 2.0**-23  # more than single precision is off, for vectors of length one
    for first in range(0, len(numbers), TILE_QUERIES):
        own = numbers[first : first + TILE_QUERIES]
        asking = matrix[own]
        rough_asking = asking.astype(np.float32)
        for start in range(0, len(vectors), TILE_PASSAGES):
            here, places = vectors[start : start + TILE_PASSAGES], at[start : start + TILE_PASSAGES]
            rough = rough_asking @ rough_vectors[start : start + TILE_PASSAGES].T
            found = np.flatnonzero(rough >= (nearest.least[own] - slack).astype(np.float32)[:, None])
            if not len(found):
                continue
            query, row = found // rough.shape[1], found % rough.shape[1]
            if len(found) * DENSE > rough.size:
                similarity = (asking @ here.T).ravel()[found]
            else:
                similarity = np.einsum("ij,ij->i", asking[query], here[row])
            nearest.add(places[row], own[query], similarity)


def _allowed(requests, pairs):
    """Candidate pairs for a block of sub-queries, given their requests: requests per entity and sub-queries per request,
    as many numbers as there are pairs and sub-queries, not their product."""
    numbers, of_entity = {}, {}
    for number, request in enumerate(requests):
        numbers.setdefault(request, []).append(number)
    place = {request: at for at, request in enumerate(numbers)}
    for request, entity in pairs:
        if request in place:
            of_entity.setdefault(entity, []).append(place[request])
    return of_entity, [np.array(own) for own in numbers.values()]


def _hit_schema(queries, passages, embedding):
    left = [f for f in queries.schema.fields if f.name != embedding]
    right = [f for f in passages.schema.fields if f.name != embedding]
    return T.StructType([*left, *right, T.StructField("distance", T.DoubleType())])


def _broadcast_form(queries, block, candidates, passages, k, embedding, bounds):
    """Scan with the sub-queries (an Arrow table within the limit) in every task.

    Returns the hits and the broadcast, which can go once the hits are stored.
    """
    spark = passages.sparkSession
    allowed = None
    if candidates is not None:
        allowed = _allowed(block["request_id"].to_pylist(), zip(candidates["request_id"].to_pylist(), candidates["entity_id"].to_pylist()))
    bound = None
    if bounds is not None:
        known = {(row["request_id"], row["query_idx"]): row["_bound"] for row in bounds.collect()}  # one per sub-query
        bound = np.array([known.get(key, np.inf) for key in zip(*(block[c].to_pylist() for c in QUERY))])
    shared = spark.sparkContext.broadcast((unit_rows(block[embedding]), block.drop_columns([embedding]), allowed, bound))

    def scan(batches):
        matrix, query_rows, allowed, bound = shared.value
        nearest = Nearest(len(matrix), k, bound)
        for batch in batches:
            if batch.num_rows:
                _offer(nearest, pa.table(batch), embedding, matrix, allowed)
        for hits in nearest.hits(query_rows):
            yield from hits.drop_columns(["pos"]).combine_chunks().to_batches()

    # In the order of their ids within a task, for ties; nothing moves for that.
    in_order = passages.sortWithinPartitions("passage_id")
    return in_order.mapInArrow(scan, _hit_schema(queries, passages, embedding)), shared


def _blocked_form(queries, candidates, passages, k, embedding):
    """The k nearest, with ``pos``, of sub-queries in blocks, each of which sees all its passages in one task.

    Blocks are cut out of the sub-queries in the order of their keys, so a request lies in few of them. Only sub-queries
    are moved: passages are stored once in the order of their ids, and each block's task reads them there. It
    holds its sub-queries, their best k so far and one batch of passages.
    """
    spark, restricted = passages.sparkSession, candidates is not None
    count = queries.count()
    size = max(1, min(QUERY_BLOCK, HELD_HITS // k))
    blocks = max(-(-count // size), min(spark.sparkContext.defaultParallelism, -(-count // min(LEAST_BLOCK, size))), 1)
    size = max(-(-count // blocks), 1)
    again = queries.groupBy(*QUERY).count().filter("count > 1").limit(1).count()
    block = F.floor(F.col("_number") / size).cast("int").alias("_block")
    streams = numbered(queries, QUERY, "_number").select(block, F.lit(0).alias("_side"), F.struct(*queries.columns).alias("_query"))
    if restricted:
        requests = streams.select("_block", F.col("_query.request_id").alias("_asked_by")).distinct()
        pairs = requests.join(candidates, F.col("_asked_by").eqNullSafe(F.col("request_id")))
        pairs = durable(pairs.select("_block", "_asked_by", F.col("entity_id").alias("_wanted")), "block-candidates")
        streams = streams.unionByName(pairs.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    streams = streams.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_side")
    stored = Ordered(passages, "passage_id", "in-order")

    def meet(batches):
        own, asked, pairs = None, [], []
        for batch in batches:
            number, side = batch.column("_block").to_numpy(), batch.column("_side").to_numpy()
            edges = np.flatnonzero((number[1:] != number[:-1]) | (side[1:] != side[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                if own != number[start]:
                    yield from searched(asked, pairs)
                    own, asked, pairs = number[start], [], []
                if side[start] == 0:
                    asked.append(_fields(part.column("_query")))
                else:
                    pairs += zip(part.column("_asked_by").to_pylist(), part.column("_wanted").to_pylist())
        yield from searched(asked, pairs)

    def searched(asked, pairs):
        if not asked:
            return
        query_rows = pa.concat_tables(asked).combine_chunks()
        matrix = unit_rows(query_rows[embedding])
        allowed = _allowed(query_rows["request_id"].to_pylist(), pairs) if restricted else None
        query_rows, nearest = query_rows.drop_columns([embedding]), Nearest(len(matrix), k)
        for table in stored.tables():
            if restricted:
                wanted = pa.array(list(allowed[0]), table["entity_id"].type)
                table = table.filter(pc.is_in(table["entity_id"], value_set=wanted, skip_nulls=True))
            _offer(nearest, table, embedding, matrix, allowed)
        for hits in nearest.hits(query_rows):
            yield from hits.combine_chunks().to_batches()

    schema = _hit_schema(queries, passages, embedding)
    hits = streams.mapInArrow(meet, T.StructType([*schema.fields, T.StructField("pos", T.IntegerType())]))
    # Sub-queries that repeat a key share its k hits.
    return keep_nearest(hits.drop("pos"), k) if again else hits


def _fields(structs):
    return pa.Table.from_batches([pa.RecordBatch.from_struct_array(structs)])


def keep_nearest(hits, k, fan=None):
    """The k nearest hits per sub-query, numbered from 1 in ``pos``.

    ``fan`` merges in two steps, so that one sub-query's hits from very many tasks do not all
    meet in a single task.
    """

    def ranked(df, *within):
        best_first = Window.partitionBy(*QUERY, *within).orderBy("distance", "passage_id")
        return df.withColumn("pos", F.row_number().over(best_first)).filter(F.col("pos") <= k)

    if fan:
        hits = ranked(hits.withColumn("_part", F.pmod(F.xxhash64("passage_id"), F.lit(fan))), "_part").drop("_part", "pos")
    return ranked(hits)


def _slice(passages, every):
    """The rows of every n-th task; the others end before they have read their split."""

    def some(batches):
        if TaskContext.get().partitionId() % every == 0:
            yield from batches

    return passages.mapInArrow(some, passages.schema)


def _if_few(df, rows):
    """``df`` as an Arrow table if it is within the limits of a broadcast, else None.

    Reads at most one row more than allowed.
    """
    table = df.limit(rows + 1).toArrow() if rows else None
    return table if table is not None and table.num_rows <= rows and table.nbytes <= BROADCAST_BYTES else None


def _groups(queries, limit, most=None):
    """The stored sub-queries in groups, by hash, that each fit a broadcast: (frame, number of groups) or None.

    None means more groups than the ``most`` that are worth while.
    """
    n, size = queries.count(), measured_bytes(queries)
    groups = max(-(-n // limit), -(-size // BROADCAST_BYTES))
    if groups > 1:
        groups = groups + -(-groups // 4)  # hashing fills groups unevenly
    if most and groups > most:
        return queries, None
    return queries.withColumn("_part", F.pmod(F.xxhash64(*QUERY), F.lit(max(groups, 1)))), max(groups, 1)


def _of_candidates(passages, candidates, pairs):
    """Only the passages of candidate entities, out of their folders only if the collection has any."""
    if pairs is None:
        entities = small(candidates.select("entity_id").distinct())
    else:
        entities = F.broadcast(passages.sparkSession.createDataFrame(pairs.select(["entity_id"]).group_by("entity_id").aggregate([])))
    passages = within(passages, entities)
    return passages.join(entities, "entity_id", "left_semi").select(*passages.columns)


def nearest_passages(
    queries, passages, k=HITS_PER_QUERY, candidates=None, embedding="embedding", broadcast_queries=BROADCAST_QUERIES, slice_every=None
):
    """The k nearest passages of every sub-query.

    ``queries``: ``request_id, query_idx, …, embedding``; ``passages``: ``passage_id, entity_id, …, embedding``;
    all other columns are carried into the hits. ``candidates`` (``request_id, entity_id``) restricts
    each request to passages of its own entities before the k nearest are taken; of a stored collection
    that keeps its folder column, only the folders concerned are read. ``k=None`` stands for the vector
    store's default number of hits. ``slice_every`` sets which share of the tasks gives bounds first;
    left out, this depends on the number of hits that the tasks would give out. Distances are rounded, so that results do not
    depend on how the work was split.
    """
    k = DEFAULT_HITS if k is None else k
    queries = queries.filter(F.col(embedding).isNotNull())
    block, pairs, groups = _if_few(queries, broadcast_queries), None, None
    if candidates is None:
        passages = within(passages)
    else:
        candidates = candidates.select("request_id", "entity_id").distinct()
        pairs = _if_few(candidates, 16 * broadcast_queries)
        candidates = candidates if pairs is not None else durable(candidates, "candidates")
        passages = _of_candidates(passages, candidates, pairs)
    passages = passages.filter(F.col(embedding).isNotNull())

    if block is None:
        queries = durable(queries, "queries")
        if not _is_scan(passages):
            passages = durable(passages, "passages")  # else computed again for every group
    # The number of scanning tasks, from what the planner knows of the files.
    spark = passages.sparkSession
    tasks = 1 + input_bytes(passages) // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    rows = block.num_rows if block is not None else queries.count()
    if broadcast_queries and (candidates is None or pairs is not None) and not _better_in_blocks(passages, rows, k, tasks):
        if block is not None:
            groups = 1
        else:
            queries, groups = _groups(queries, broadcast_queries, None if candidates is None else SCANS)
    if not groups:
        if pairs is not None:
            candidates = durable(candidates, "candidates")
        return _blocked_form(queries, candidates, passages, k, embedding)
    many = tasks * rows * k > MANY_HITS
    fan, every = (MERGE_FAN if many else None), slice_every or (max(1, tasks // SLICE_TASKS) if many else None)

    def search(passages, bounds):
        if block is not None:
            hits, _ = _broadcast_form(queries, block, pairs, passages, k, embedding, bounds)
        else:
            # One group after another, so that the driver holds one at a time.
            hits, own = None, queries.drop("_part")
            for number in range(groups):
                part = queries.filter(F.col("_part") == number).drop("_part").toArrow()
                if part.num_rows:
                    found, shared = _broadcast_form(own, part, pairs, passages, k, embedding, bounds)
                    found = durable(found, "hits")
                    shared.destroy()
                    hits = found if hits is None else hits.unionByName(found)
        return keep_nearest(hits, k, fan)

    bounds = None
    if every and every > 1:
        last = search(_slice(passages.select("passage_id", "entity_id", embedding), every), None).filter(F.col("pos") == k)
        bounds = durable(last.select(*QUERY, F.col("distance").alias("_bound")), "bounds")
    return search(passages, bounds)


def _better_in_blocks(passages, queries, k, tasks):
    """Whether blocks of sub-queries should each read all passages: where scanning tasks are too few for the cores, or
    where their hits take more room than the passages read by all blocks."""
    if queries * passages.count() < MANY_PAIRS:
        return False
    blocks = -(-queries // max(1, min(QUERY_BLOCK, HELD_HITS // k)))
    return tasks < passages.sparkSession.sparkContext.defaultParallelism or tasks * queries * k * HIT_BYTES > input_bytes(passages) * blocks


def _is_scan(df):
    """Whether ``df`` only reads, selects and filters stored files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(name in plan for name in ("Join", "Aggregate", "MapInArrow", "Window", "Generate", "Repartition"))

