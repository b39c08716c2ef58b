"""Running totals that never hold one group, however large, in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank.plans.sizing import durable, input_bytes, is_narrow


ROWS_PER_TASK = 4_000_000


def largest_group(df, keys):
    """Rows of the largest group, by a count that is combined before it is shuffled."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("rows")).first()["rows"]


def running_totals(df, values, order, keys=(), rows_per_task=ROWS_PER_TASK):
    """Add a column per item of ``values`` (name: number): its sum over the rows of a key up to and
    including this one.

    ``keys + order`` must identify a row. Where every group is measured to fit a task this is a
    window per key; else the groups are cut into blocks.
    """
    keys, order = list(keys), list(order)
    valued = df.withColumns({f"_{name}": value for name, value in values.items()})
    if largest_group(df, keys) <= rows_per_task:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        totals = valued.withColumns({name: F.sum(f"_{name}").over(so_far) for name in values})
    else:
        totals = _blocked_totals(valued, values, order, keys, rows_per_task)
    return totals.select(*df.columns, *values)


def _blocked_totals(df, names, order, keys, rows_per_task):
    """Rows are range-partitioned on ``keys + order``, so a hot key spreads over as many blocks as
    its size calls for. Each block sums on its own and adds the total of the key's earlier blocks;
    of a block, only that one row meets with those of other blocks.
    """
    spark = df.sparkSession
    blocks = max(-(-df.count() // rows_per_task) * 2, spark.sparkContext.defaultParallelism)
    # Stored before use: both readers below must see the same block numbers, also after a retry.
    placed = durable(
        df.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id()), "blocks"
    )
    earlier_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_block").agg(*[F.sum(f"_{name}").alias(f"_total_{name}") for name in names])
        .withColumns({f"_before_{name}": F.coalesce(F.sum(f"_total_{name}").over(earlier_blocks), F.lit(0)) for name in names})
        .select(
            *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_of_block"), *[f"_before_{name}" for name in names]
        )
    )
    same_block = F.col("_block") == F.col("_of_block")
    for k in keys:
        same_block = same_block & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(offsets, same_block).withColumns(
        {name: F.sum(f"_{name}").over(inside) + F.col(f"_before_{name}") for name in names}
    )


def running_total(df, value, out, order, keys=(), rows_per_task=ROWS_PER_TASK):
    """``running_totals`` of a single value."""
    return running_totals(df, {out: value}, order, keys, rows_per_task)


# Bytes of input that a range stands for when rows are numbered; ranges grow in number with the input.
RANGE_BYTES = 64 << 20
_PARTITION = (1 << 33) - 1  # the part of a generated id that counts within a partition


def numbered(df, order, out, first=0, ranges=None):
    """Number the rows from ``first`` on in the given order, as a long; ``order`` must identify a row.

    Pass one sorts the input by ranges and stores each row with its range and its place there. Pass two
    adds where the range begins: the driver holds one count per range. No task sees more than a range, at any
    size. Finding the ranges reads the input as well, so one that is more than a scan and row-wise work is stored first.
    """
    spark = df.sparkSession
    stored = df if is_narrow(df) else durable(df, "unnumbered")
    ranges = ranges or max(-(-input_bytes(stored) // RANGE_BYTES), spark.sparkContext.defaultParallelism)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PARTITION))
    by_range = stored.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    by_range = durable(by_range.select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    begins, total = [], first
    for row in by_range.groupBy("_range").count().orderBy("_range").collect():
        begins.append((row["_range"], total))
        total += row["count"]
    begins = F.broadcast(spark.createDataFrame(begins, "_of int, _begin long"))
    number = (F.col("_place") + F.col("_begin")).alias(out)
    return by_range.join(begins, F.col("_range") == F.col("_of")).select(*[F.col(f"`{c}`") for c in df.columns if c != out], number)


def dense_ids(df, order, out="row_id", ranges=None):
    """``numbered`` from 0 on, the number as a string."""
    return numbered(df, order, out, 0, ranges).withColumn(out, F.col(out).cast("string"))
