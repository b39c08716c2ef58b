"""The relational store: create, scan, append, replace the children of a parent."""

from pyspark.sql import functions as F

from passarank.plans.sizing import durable, small
from passarank.sources.snapshots import bucket_folders, fresh_folder, publish, snapshot

BUCKETS = 1024
# The folder column's name tells the number of buckets.
COLUMN = "bucket_of_"


def create_if_absent(spark, name, schema, path):
    """Create an empty table from its schema unless it exists already."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields
    )
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted} ({columns}) USING parquet LOCATION '{place}'")


def append(df, path):
    df.write.mode("append").parquet(path)


def scan(spark, path, schema):
    return spark.read.schema(schema).parquet(path)


def last_id(spark, path, schema, key="id"):
    """The largest id in a stored table, 0 if it has no rows; new records are numbered after it."""
    return scan(spark, path, schema).agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).first()["last"]


def store(df, path):
    df.write.mode("errorifexists").parquet(path)


def replace_children(existing, parents, children, key):
    """The child table after the children of ``parents`` have been replaced by ``children``.

    Parents keep none of their old rows, even if they get no new ones. Parents are broadcast while
    that is cheap; else the join is shuffled and adaptive execution splits a hot parent's rows.
    Write the result to a fresh path: a table cannot be overwritten while it is read.
    """
    replaced = small(durable(parents.select(key).distinct(), "parents"))
    return existing.join(replaced, key, "left_anti").select(*existing.columns).unionByName(children)


def _bucketed(df, key, column):
    return df.withColumn(column, F.pmod(F.xxhash64(key), F.lit(int(column.removeprefix(COLUMN)))).cast("int"))


def store_children(children, path, key, buckets=BUCKETS):
    """Store children in one folder per bucket of parents, as the next version of the table at ``path``."""
    number, folder = fresh_folder(children.sparkSession, path)
    publish(children.sparkSession, path, number, _written(children, path, folder, key, f"{COLUMN}{buckets}"))


def _written(rows, path, folder, key, column):
    """Write rows by bucket; the folders of all buckets, those without rows as null."""
    _bucketed(rows, key, column).hint("rebalance", column).write.partitionBy(column).parquet(f"{path}/{folder}")
    buckets = int(column.removeprefix(COLUMN))
    return {str(n): None for n in range(buckets)} | bucket_folders(rows.sparkSession, path, folder, column)


def scan_children(spark, path, schema, key, version=None):
    """The children of the newest version, or of one given by number."""
    found = snapshot(spark, path, version)
    return _read_folders(spark, path, schema, found.folders.values()).filter(F.col(key).isNotNull())


def _read_folders(spark, path, schema, folders):
    stored = [f"{path}/{folder}" for folder in folders if folder]
    if not stored:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*stored).select(*schema.names)


def replace_stored_children(spark, path, schema, parents, children, key):
    """``replace_children`` of a stored table: only the buckets of the parents concerned are read and written anew.

    All at once or not at all: the next version names the new folders of these buckets and the old ones
    of all others. Returns the new version's number.
    """
    old = snapshot(spark, path)
    column = f"{COLUMN}{len(old.folders)}"
    concerned = _bucketed(parents.select(key).unionByName(children.select(key)), key, column).select(column).distinct()
    numbers = [str(row[column]) for row in concerned.collect()]  # at most one number per bucket
    kept = _read_folders(spark, path, schema, [old.folders[n] for n in numbers]).filter(F.col(key).isNotNull())
    number, folder = fresh_folder(spark, path)
    written = _written(replace_children(kept, parents, children, key), path, folder, key, column)
    publish(spark, path, number, old.folders | {n: written[n] for n in numbers})
    return number
