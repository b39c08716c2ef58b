"""Centroid clustering in exact integers, with bounds that skip most distances (Shallot).

Every vector remembers its nearest and second-nearest centroid, an upper bound of the distance to the
first and a lower bound of the distance to all others. After the centroids move, the bounds move by as
much; a vector whose upper bound stays below its lower bound, or below half the way from its centroid to
the next one, keeps its cluster without any distance. Other vectors measure both remembered centroids and
start from the closer one: its neighbours are visited from near to far, and no centroid farther from it than
the sum of both best distances so far can be one of the two nearest, so the ball shrinks with every find.
Bounds are floating-point numbers with a margin; whatever survives them is compared in integers, ties going
to the smaller number.

Vectors lie in blocks, one row each, in a table bucketed by block; the remembered numbers of every round are a
table with the same buckets. Joining them moves nothing, and a lost executor rereads stored tables.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm.common import placed
from passarank.plans.sizing import durable, scratch_path

BLOCK_ROWS, BUCKET_BYTES = 4096, 64 << 20
# Components beyond this would let a squared distance leave the long type.
LARGEST = 1 << 27
_MARGIN = 1 + 1e-9


def squared(vectors, centroids):
    """Exact squared distances, row by row."""
    gap = vectors - centroids
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """Centroids of a round with what the search needs: the ways between them and how far they moved."""

    def __init__(self, points, before=None):
        self.points = points
        count = len(points)
        apart = points[:, None, :].astype(np.float64) - points[None, :, :]
        self.apart = np.sqrt((apart**2).sum(axis=2))
        others = self.apart + np.diag(np.full(count, np.inf))
        self.half = others.min(axis=1, initial=np.inf) / 2
        self.neighbours = np.argsort(others, axis=1, kind="stable")[:, : count - 1]
        moved = np.zeros(count) if before is None else np.sqrt(((points - before).astype(np.float64) ** 2).sum(axis=1))
        self.moved = moved
        self.others_moved = np.array([np.delete(moved, j).max(initial=0.0) for j in range(count)])


def assign(vectors, state, centroids):
    """The remembered numbers after a move: (nearest, second, upper, lower); state None in the first round."""
    size, count = len(vectors), len(centroids.points)
    if state is None:
        near, second = np.zeros(size, np.int64), np.full(size, min(1, count - 1))
        upper, lower = np.full(size, np.inf), np.zeros(size)
    else:
        near, second, upper, lower = (part.copy() for part in state)
        upper = (upper + centroids.moved[near]) * _MARGIN
        lower = (lower - centroids.others_moved[near]) / _MARGIN
    if count == 1:
        return near, second, upper, np.full(size, np.inf)

    def unsure(rows):
        return rows[upper[rows] * _MARGIN >= np.maximum(lower[rows], centroids.half[near[rows]])]

    rows = unsure(np.arange(size))
    first = squared(vectors[rows], centroids.points[near[rows]])
    upper[rows] = np.sqrt(first)
    left = unsure(rows)
    first = first[np.searchsorted(rows, left)]
    rows = left
    if not rows.size:
        return near, second, upper, lower
    best, next_best = near[rows], second[rows]
    other = squared(vectors[rows], centroids.points[next_best])
    swap = (other < first) | ((other == first) & (next_best < best))
    best, next_best = np.where(swap, next_best, best), np.where(swap, best, next_best)
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    origin, remembered = best.copy(), next_best.copy()
    way = np.sqrt(first)
    alive = np.arange(rows.size)
    for turn in range(count - 1):
        nearby = centroids.neighbours[origin[alive], turn]
        ball = (way[alive] + np.sqrt(other[alive])) * _MARGIN
        inside = centroids.apart[origin[alive], nearby] <= ball
        alive, nearby = alive[inside], nearby[inside]
        if not alive.size:
            break
        new = np.flatnonzero(nearby != remembered[alive])
        at, centre = alive[new], nearby[new]
        distance = squared(vectors[rows[at]], centroids.points[centre])
        wins = (distance < first[at]) | ((distance == first[at]) & (centre < best[at]))
        closer = ~wins & (distance < other[at])
        won, near_won = at[wins], at[closer]
        other[won], next_best[won] = first[won], best[won]
        first[won], best[won] = distance[wins], centre[wins]
        other[near_won], next_best[near_won] = distance[closer], centre[closer]
    near[rows], second[rows] = best, next_best
    upper[rows], lower[rows] = np.sqrt(first), np.sqrt(other)
    return near, second, upper, lower


def whole_numbers(vectors, id_col, vector_col, dimensions, scale):
    """``id`` and ``parts``: floor(scale · component) of vectors with ``dimensions`` finite components,
    with their place in their file."""
    named = placed(vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector")))
    values = F.col("row.vector").cast("array<double>")
    # NaN is above all numbers, so one comparison leaves out both.
    finite = F.forall(values, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    parts = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))))
    return named.filter((F.size(values) == dimensions) & finite).select("row.id", parts.alias("parts"), "file_key", "row_no")


def first_centroids(rows, count, seed):
    """The parts of the ``count`` vectors with the smallest digests of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.select(digest.alias("digest"), "parts").orderBy(F.col("digest").asc_nulls_last(), "parts").limit(count)
    return np.array([r["parts"] for r in chosen.collect()], np.int64)


def _checked(values):
    if values.size and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST}; its squared distance would leave the long type")
    return values


def _blocks(dimensions):
    def blocks(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                values = _checked(part.column("parts").flatten().to_numpy(zero_copy_only=False))
                packed = values.astype(np.int32).reshape(-1, dimensions)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("block").slice(0, 1), ids, pa.array([packed.tobytes()], pa.binary())], ["block", "ids", "vectors"]
                )

    return blocks


def bucketed(df, key, buckets):
    """Store ``df`` in buckets by ``key`` in the shared folder; tables of equal buckets join without a shuffle."""
    spark = df.sparkSession
    name, path = f"passarank_{uuid.uuid4().hex}", scratch_path(df.sparkSession, "buckets")
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    table = spark.table(name)
    # Only the catalog entry of this external table goes; its files stay, and ``table`` knows them.
    spark.sql(f"DROP TABLE {name}")
    return table


STATE = "block long, near binary, second binary, upper binary, lower binary, counts array<long>, sums array<long>"


def _unpack(row, dimensions):
    return np.frombuffer(row, np.int32).reshape(-1, dimensions).astype(np.int64)


def _round(points, before, dimensions):
    """Arrow batches of blocks with their state to the next state and the sums of every cluster."""

    def step(batches):
        centroids = Centroids(points, before)
        count = len(points)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _unpack(row["vectors"], dimensions)
                state = assign(vectors, _remembered(row), centroids)
                members = np.bincount(state[0], minlength=count)
                sums = np.zeros((count, dimensions), np.int64)
                np.add.at(sums, state[0], vectors)
                kinds = (np.int32, np.int32, np.float64, np.float64)
                packed = [pa.array([part.astype(kind).tobytes()], pa.binary()) for part, kind in zip(state, kinds)]
                lists = [pa.array([values.tolist()], pa.list_(pa.int64())) for values in (members, sums.ravel())]
                names = ["block", "near", "second", "upper", "lower", "counts", "sums"]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *packed, *lists], names)

    return step


def _remembered(row):
    if row.get("near") is None:
        return None
    whole = [np.frombuffer(row[name], np.int32).astype(np.int64) for name in ("near", "second")]
    return (*whole, np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))


def _finish(points, before, dimensions):
    """Arrow batches of blocks with their state to a row per vector: id, cluster, exact distance."""

    def step(batches):
        centroids = Centroids(points, before)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = _unpack(row["vectors"], dimensions)
                near = assign(vectors, _remembered(row), centroids)[0]
                distance = squared(vectors, points[near])
                columns = [pa.array(row["ids"], pa.int64()), pa.array(near.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return step


def _moved(state, points):
    """The centroids after a round: floor of the mean of their vectors; empty ones stay."""
    count, dimensions = points.shape
    every = state.select(F.posexplode(F.concat("counts", "sums")).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total"))
    totals = {r["at"]: r["total"] for r in every.collect()}
    members, sums = [totals[j] for j in range(count)], [totals[count + j] for j in range(count * dimensions)]
    after = points.copy()
    for j in range(count):
        if members[j]:
            after[j] = [sums[j * dimensions + i] // members[j] for i in range(dimensions)]
    return after


def clusters(vectors, count=8, rounds=10, seed=3, id_col="vec_id", vector_col="embedding", dimensions=64, scale=1024):
    """Cluster vectors: (rows, centroids). Rows hold ``id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; centroids are an integer array.

    Components become floor(scale · component). The first centroids are the vectors with the smallest
    SHA-256 of ``seed:id``, fewer if there are fewer vectors. Each of the ``rounds`` assigns all vectors,
    then replaces every centroid that has vectors by the floor of their mean. All numbers are exact and do not
    depend on how rows are split.

    Vectors that are null, of another length, or hold a null or non-finite component take no part; an
    input without any other gives no rows. Repeated rows count each, also as first centroids; rows
    without an id take part and their digests come last. Of two centroids at the same distance the smaller number
    wins. Other columns are not read. A component beyond 2^27 after scaling is an error, since the
    result's long could not hold its squared distance. The driver holds ``count`` centroids and nothing else.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col, dimensions, scale)
    points = _checked(first_centroids(rows, count, seed))
    schema = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(points):
        return spark.createDataFrame([], schema), np.empty((0, dimensions), np.int64)
    total = rows.count()
    buckets = max(-(-total * dimensions * 4 // BUCKET_BYTES), min(spark.sparkContext.defaultParallelism, -(-total // BLOCK_ROWS)))

    named = rows.select("id", "parts", F.xxhash64("file_key", "row_no").alias("block"))
    blocks = named.mapInArrow(_blocks(dimensions), "block long, ids array<long>, vectors binary")
    blocks = bucketed(blocks.repartition(buckets, "block"), "block", buckets)
    state, before = None, None
    for _ in range(rounds):
        state = _joined(blocks, state).mapInArrow(_round(points, before, dimensions), STATE)
        state = bucketed(state, "block", buckets)
        before, points = points, _moved(state, points)
    found = durable(_joined(blocks, state).mapInArrow(_finish(points, before, dimensions), "id long, cluster int, distance long"), "clusters")

    per_cluster = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    whole = sum(per_cluster.values())
    facts = [
        (j, per_cluster[j], whole, hashlib.sha256(",".join(map(str, points[j].tolist())).encode()).hexdigest()) for j in sorted(per_cluster)
    ]
    # At most ``count`` rows.
    per_cluster = F.broadcast(spark.createDataFrame(facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(per_cluster, F.col("cluster") == F.col("of")).drop("of"), points


def _joined(blocks, state):
    """Blocks with what they remember; equal buckets on both sides, so nothing is shuffled."""
    return blocks if state is None else blocks.join(state.select("block", "near", "second", "upper", "lower").hint("merge"), "block")
