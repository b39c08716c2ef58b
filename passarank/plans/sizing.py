"""Durable intermediate tables and broadcasts behind a measured size."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
# The files of a job's shuffles go when the job ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark, name):
    """A fresh path in the folder that all nodes of the cluster share, named by ``spark.checkpoint.dir``.

    The setting is trusted to name a shared folder. Only where it is unset and the whole session is one
    local process, as in tests, a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every node can reach")
        base = tempfile.mkdtemp(prefix="passarank-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/passarank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def storing(spark, split_bytes=None):
    """Settings for a job that stores rows: its shuffle files go with its end, as what is stored takes their place.

    ``split_bytes`` bounds the splits in which files are read meanwhile, for rows that grow much on their way.
    """
    wanted = {CLEANUP: "true"}
    if split_bytes:
        own = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        wanted["spark.sql.files.maxPartitionBytes"] = str(min(own, split_bytes))
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def durable(df, name="stage"):
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives lost executors; unlike a checkpointed RDD the table is
    columnar, so readers still prune columns and the planner knows its size.
    """
    path = scratch_path(df.sparkSession, name)
    with storing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark, path):
    """Delete a folder made by ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _width(value, kind):
    """Bytes that one value takes, as a column."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            items = F.aggregate(value, F.lit(0).cast("long"), lambda total, item: total + _width(item, kind.elementType))
        else:
            items = F.size(value) * 8
        size = items + 16
    elif isinstance(kind, T.MapType):
        size = _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_width(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16))
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def measured_bytes(df):
    """Bytes that the rows of ``df`` take, nested values included, from one aggregate over it."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def small(df, limit=BROADCAST_BYTES):
    """``df`` marked for broadcast if its measured size allows it, else unchanged.

    Unchanged means a shuffled join, whose skewed partitions adaptive execution splits.
    Call it on stored tables: the measurement reads ``df`` once.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def input_bytes(df):
    """Size of the tables that ``df`` reads, as the planner knows it.

    It only chooses between plans with equal results.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def is_narrow(df):
    """Whether ``df`` only reads stored files, dealt out by ``spread`` if at all, and works row by row in the JVM, so
    that reading it twice is cheap."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    moving = ("Join", "Aggregate", "Window", "RepartitionBy", "RebalancePartitions", "Sort ", "Limit", "InArrow", "Python", "InPandas", "LogicalRDD")
    return not any(name in plan for name in moving)


def spread(df):
    """Deal out the rows of an input that is too small to give every core a file split.

    Meant for expensive work per row. An input of ordinary size has splits enough and is not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    thin = input_bytes(df) < cores * split and len(df.inputFiles()) < cores
    return df.repartition(cores) if thin else df
