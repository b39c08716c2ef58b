"""What the operators share: stored rows with a stable place, Arrow maps, prefix sums over blocks."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank.plans.sizing import durable
from passarank.plans.stored import open_folder  # noqa: F401


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(rows):
    """The rows as one struct ``row`` with a stable place: ``file_key`` and ``row_no``.

    The place is where the row lies in its file, so every scan, also one after a lost executor,
    gives it again. Rows that are not a plain scan of files are stored first.
    """
    at = [F.xxhash64("_metadata.file_path").alias("file_key"), F.col("_metadata.row_index").alias("row_no")]
    boxed = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    try:
        return rows.select(boxed, *at)
    except AnalysisException:
        return durable(rows.select(boxed), "rows").select("row", *at)


def boxed(rows, name="row"):
    """All columns of the rows as one struct, so that names of their own cannot clash with others."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name)


def qualified(spark, path):
    """A path with the scheme of Spark's default file system, for readers that take a bare path as the machine's own."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(made).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def blocked_prefix(rows, value, order, block, keys=()):
    """The sum of ``value`` over the earlier rows of a key, where ``block`` orders before ``order``.

    Only block sums meet per key; the rows of one block are summed in one task. The caller chooses
    blocks of bounded size. Returns the rows with a column ``before``.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, block).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(block).alias("_k_block"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"),
    )
    same = F.col(block) == F.col("_k_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, same).select(
        *rows.columns, (F.col("_inside") + F.col("_start")).cast("long").alias("before")
    )
