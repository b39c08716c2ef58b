"""Vector collections as bucketed tables, each rebuild a new version that becomes visible at once."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.plans.sizing import input_bytes, storing
from passarank.sources.snapshots import fresh_folder, publish, snapshot

# Bytes of input a folder stands for, and the most folders there are.
FOLDER_BYTES, MOST_FOLDERS = 256 << 20, 4096
ROWS_PER_FILE = 1_000_000
# Row groups this small, with sorted entity ids and Bloom filters of all ids, let lookups leave most of a file out.
GROUP_BYTES = 16 << 20
# Bytes of a collection that a task reads to make another one: their sentences and vectors take many times as much.
SPLIT_BYTES = 16 << 20
COMPRESSION = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5"}
# The folder column's name tells the number of buckets, so that readers hash as the writer did.
COLUMN = "bucket_of_"


def _bucket(entity, buckets):
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def folder_count(df):
    """Folders for a collection made from ``df``, by the bytes that it reads."""
    return max(1, min(MOST_FOLDERS, -(-input_bytes(df) // FOLDER_BYTES)))


def rebuild(df, path, entity="entity_id", buckets=None, group_bytes=GROUP_BYTES, add=None, dealt=False):
    """Write a collection anew, one folder per bucket of entities, and make it the one that readers open.

    ``buckets`` is taken from the size of the input if it is left out. The rebalance gives each bucket few files
    and splits the bucket of a hot entity over several tasks. Entity ids are sorted within a file, and every id
    column has a Bloom filter, so lookups skip row groups. The version before stays readable; see ``snapshots``.
    ``add`` maps the dealt out rows to the rows with further columns, such as vectors, which then are not moved.
    ``dealt`` says that the rows are made, row by row, out of a collection with as many ``buckets`` of the same entities:
    each of its files then lies in one folder's bucket, and nothing is moved at all. Returns the version's number.
    """
    spark, buckets = df.sparkSession, buckets or folder_count(df)
    name = f"{COLUMN}{buckets}"
    number, folder = fresh_folder(spark, path)
    rows = df.withColumn(name, _bucket(entity, buckets))
    if not dealt:
        rows = rows.hint("rebalance", name)
    rows = add(rows) if add else rows
    writer = rows.sortWithinPartitions(name, entity).write
    for column in rows.columns:
        if column.endswith("_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer = writer.option("parquet.block.size", group_bytes).option("maxRecordsPerFile", ROWS_PER_FILE).options(**COMPRESSION)
    with storing(spark, SPLIT_BYTES if dealt else None):
        writer.partitionBy(name).parquet(f"{path}/{folder}")
    publish(spark, path, number, {"": folder, "buckets": name})
    return number


def read_collection(spark, path, schema, with_bucket=False, version=None):
    """Read a collection's newest version; ``with_bucket`` keeps the folder column, by which ``within`` can prune."""
    found = snapshot(spark, path, version).folders
    whole = T.StructType([*schema.fields, T.StructField(found["buckets"], T.IntegerType())])
    collection = spark.read.schema(whole).parquet(f"{path}/{found['']}")
    return collection if with_bucket else collection.select(*schema.names)


def within(collection, entities=None, entity="entity_id"):
    """A collection without its folder column, read only in the buckets of ``entities`` if given."""
    names = [c for c in collection.columns if c.startswith(COLUMN)]
    if entities is not None and names:
        buckets = int(names[0].removeprefix(COLUMN))
        wanted = entities.select(_bucket(entity, buckets).alias("bucket")).distinct()
        # At most ``buckets`` numbers, known before the scan is planned: whole folders are left out.
        collection = collection.filter(F.col(names[0]).isin([row["bucket"] for row in wanted.collect()]))
    return collection.drop(*names)
