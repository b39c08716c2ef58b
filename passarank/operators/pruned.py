"""Exact nearest passages from a collection stored in cells, leaving out cells that cannot hold a hit.

Passages are stored by the nearest of a bounded number of pivots, one folder per pivot, with the largest angle of
a cell's members to its pivot. Angles obey the triangle inequality: no member of a cell is closer to a
sub-query than the angle to the pivot less that radius. The search first looks where the sub-query lies;
the k-th distance found there is an upper bound, and only cells that may hold something within it are read
after that. Results are those of a search through everything, ties included.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.fixed_values import HITS_PER_QUERY
from passarank.operators.knn import QUERY, keep_nearest, nearest_passages, unit_rows
from passarank.plans.sizing import durable
from passarank.sources.snapshots import fresh_folder, publish, snapshot

# Passages a cell stands for, and the most cells there are: their pivots are held in every task.
CELL_PASSAGES, MOST_CELLS = 20_000, 1024
# A cell of its own for vectors without a direction, whose distance to everything is 1.
NO_DIRECTION = -1
# Angles and distances are compared with this much to spare, as distances are rounded to six digits.
SPARE = 2e-6


def _angles(vectors, pivots):
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def store_cells(passages, path, cells=None, embedding="embedding"):
    """Store passages (``passage_id, entity_id, …, embedding``) by cell, as the next version of the collection.

    Pivots are the passages with the smallest hashes of their ids. Rows without a vector are stored in no cell.
    """
    spark = passages.sparkSession
    rows = durable(passages.filter(F.col(embedding).isNotNull()), "passages")
    count = cells or max(1, min(MOST_CELLS, -(-rows.count() // CELL_PASSAGES)))
    some = F.exists(embedding, lambda x: x != 0)
    chosen = rows.filter(some).select(embedding).orderBy(F.xxhash64("passage_id"), "passage_id").limit(count).toArrow()
    pivots = unit_rows(chosen[embedding])

    def assign(batches):
        for batch in batches:
            vectors = unit_rows(batch.column(embedding))
            cell, angle = np.full(len(vectors), NO_DIRECTION), np.zeros(len(vectors))
            known = (vectors != 0).any(axis=1) if len(vectors) else np.empty(0, bool)
            if known.any():
                angles = _angles(vectors[known], pivots)
                cell[known], angle[known] = angles.argmin(axis=1), angles.min(axis=1)
            columns = [*batch.columns, pa.array(angle), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_angle", "cell"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    number, folder = fresh_folder(spark, path)
    assigned = durable(rows.mapInArrow(assign, schema), "assigned")
    facts = {r["cell"]: (r["members"], r["radius"]) for r in
             assigned.groupBy("cell").agg(F.count("*").alias("members"), F.max("_angle").alias("radius")).collect()}
    table = [(c, pivots[c].tolist() if c != NO_DIRECTION else None, *facts[c]) for c in sorted(facts)]
    spark.createDataFrame(table, "cell int, pivot array<double>, members long, radius double").coalesce(1).write.parquet(f"{path}/{folder}/cells")
    assigned.drop("_angle").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/{folder}/rows")
    publish(spark, path, number, {"rows": f"{folder}/rows", "cells": f"{folder}/cells"})


class Cells:
    """A stored collection: its cells' pivots, radii and members, and its rows by cell."""

    def __init__(self, spark, path, schema):
        folders = snapshot(spark, path).folders
        self.spark, self.rows, self.schema = spark, f"{path}/{folders['rows']}", schema
        table = sorted(spark.read.parquet(f"{path}/{folders['cells']}").collect(), key=lambda r: r["cell"])
        self.numbers = np.array([r["cell"] for r in table], np.int64)
        self.members = np.array([r["members"] for r in table], np.int64)
        self.radius = np.array([r["radius"] for r in table])
        self.directed = self.numbers != NO_DIRECTION
        self.pivots = np.array([r["pivot"] for r in table if r["pivot"]])

    def read(self, numbers):
        """The passages of some cells, with the cell as ``cell``: the folders of all others are left out."""
        if not numbers:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType())]))
        whole = T.StructType([*self.schema.fields, T.StructField("cell", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(self.rows).filter(F.col("cell").isin([int(n) for n in numbers]))

    def distances(self, vectors):
        """Angle to every cell, and the least distance that a member can have."""
        angle = np.full((len(vectors), len(self.numbers)), np.pi / 2)
        low = np.ones_like(angle)
        if self.directed.any() and len(vectors):
            known = (vectors != 0).any(axis=1)
            angle[np.ix_(known, self.directed)] = _angles(vectors[known], self.pivots)
            closest = np.maximum(angle[:, self.directed] - self.radius[self.directed] - SPARE, 0.0)
            low[np.ix_(known, self.directed)] = (1.0 - np.cos(closest))[known]
        return angle, low - SPARE


def _where(queries, cells, k, embedding):
    """``request_id, query_idx, cell, low, near`` per sub-query and cell; ``near`` cells come first and hold k passages."""

    def where(batches):
        for batch in batches:
            angle, low = cells.distances(unit_rows(batch.column(embedding)))
            order = np.argsort(angle, axis=1, kind="stable")
            sizes = np.cumsum(cells.members[order], axis=1) - cells.members[order]
            near = np.zeros_like(angle, bool)
            np.put_along_axis(near, order, sizes < k, axis=1)
            row, cell = np.divmod(np.arange(angle.size), len(cells.numbers))
            keys = [batch.column(name).take(pa.array(row)) for name in QUERY]
            found = [pa.array(cells.numbers[cell].astype(np.int32)), pa.array(low.ravel()), pa.array(near.ravel())]
            yield pa.RecordBatch.from_arrays([*keys, *found], [*QUERY, "cell", "low", "near"])

    kinds = [queries.schema[name] for name in QUERY]
    schema = T.StructType([*kinds, T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("near", T.BooleanType())])
    held = Cells.__new__(Cells)  # what tasks need, without the session
    held.numbers, held.members, held.radius, held.directed, held.pivots = cells.numbers, cells.members, cells.radius, cells.directed, cells.pivots
    cells = held
    return queries.select(*QUERY, embedding).mapInArrow(where, schema)


def nearest_in_cells(queries, cells, k=HITS_PER_QUERY, embedding="embedding", **options):
    """``nearest_passages`` of a collection stored by ``store_cells`` and opened as ``Cells``: the same hits.

    Sub-queries and cells meet as one small row per pair that may matter, not as vectors.
    """
    queries = durable(queries.filter(F.col(embedding).isNotNull()), "queries")
    where = durable(_where(queries, cells, k, embedding), "where")
    first = _hits(queries, cells, where.filter("near"), k, embedding, options)
    bounds = first.filter(F.col("pos") == k).select(*QUERY, F.col("distance").alias("_bound"))
    # A sub-query with fewer than k hits so far has seen all cells.
    more = where.filter("not near").join(bounds, QUERY).filter(F.col("low") <= F.col("_bound"))
    second = _hits(queries, cells, durable(more, "more"), k, embedding, options)
    return keep_nearest(first.unionByName(second).drop("pos"), k)


def _hits(queries, cells, pairs, k, embedding, options):
    """The nearest passages of every sub-query in its own cells, stored."""
    numbers = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # at most one per cell
    key = F.to_json(F.struct(*QUERY))
    asked = queries.withColumn("_request", F.col("request_id")).withColumn("request_id", key)
    passages = cells.read(numbers).withColumn("_entity", F.col("entity_id")).withColumn("entity_id", F.col("cell").cast("string")).drop("cell")
    candidates = pairs.select(key.alias("request_id"), F.col("cell").cast("string").alias("entity_id"))
    hits = nearest_passages(asked, passages, k, candidates, embedding, **options)
    return durable(
        hits.withColumn("request_id", F.col("_request")).withColumn("entity_id", F.col("_entity")).drop("_request", "_entity"), "hits"
    )
