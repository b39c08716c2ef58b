"""Global shuffle into shards in two passes over external storage, with DataFrame functions alone.

Pass one scatters the rows by a seeded hash into buckets that fit a task's memory. Pass two
permutes each bucket by Fisher-Yates (Spark's ``shuffle`` of an array) and writes it. Buckets one
after another are one random order of all rows, which is cut into shards of equal row counts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm.common import placed
from passarank.plans.sizing import scratch_path

LAW = "rows"
BUCKET_BYTES, BUCKET_ROWS = 24 << 20, 250_000


def shuffled_shards(docs, shards, path=None, id_col="doc_id", text_col="text", seed=20, bucket_bytes=BUCKET_BYTES, bucket_rows=BUCKET_ROWS):
    """Write all rows to ``path`` as shards 0 to ``shards`` − 1 in a seeded random order and read them back.

    The law is ``rows``: shard sizes differ by one row at most. Columns ``shard`` and ``slot`` (from 0
    without gaps) are added; input columns of these names are dropped. One Parquet folder per shard
    holds its rows in files in slot order. With fewer rows than shards the last shards are empty.

    A row is scattered by its id and its place in its file, so copies, repeated rows and null ids
    spread like all others, and a task that runs again puts every row where it was. Null texts count
    no bytes; they, empty texts and ties are shuffled like any row. ``bucket_bytes`` bounds what one
    task holds on average; buckets grow in number with the input.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    path = path or scratch_path(spark, "shards")
    rows = placed(docs.select(*[F.col(f"`{c}`") for c in kept]))
    weight = F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)) + 64
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(weight.cast("long")), F.lit(0)).alias("bytes")).first()
    buckets = max(-(-total["bytes"] // bucket_bytes), -(-total["rows"] // bucket_rows), 1)
    if total["rows"] > buckets:
        buckets = max(buckets, min(spark.sparkContext.defaultParallelism, total["rows"]))

    order = F.xxhash64(F.lit(seed), F.col("row")[id_col], F.col("file_key"), F.col("row_no"))
    scattered = rows.select(F.pmod(order, F.lit(buckets)).cast("int").alias("bucket"), order.alias("place"), "file_key", "row_no", "row")
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("bucket").alias("of"), F.coalesce(before, F.lit(0)).alias("start"))

    boxes = (
        scattered.repartitionById(buckets, "bucket")
        .sortWithinPartitions("bucket", "place", "file_key", "row_no")
        .groupBy("bucket").agg(F.collect_list("row").alias("box"))
        .withColumn("box", F.shuffle("box", seed))
    )
    each, extra = divmod(total["rows"], shards)
    number = F.col("start") + F.col("i")
    long_part = extra * (each + 1)
    rest = number - F.lit(long_part)
    shard = F.when(number < long_part, F.floor(number / (each + 1))).otherwise(extra + F.floor(rest / max(each, 1)))
    slot = F.when(number < long_part, F.pmod(number, F.lit(each + 1))).otherwise(F.pmod(rest, F.lit(max(each, 1))))
    numbered = (
        boxes.select("bucket", F.posexplode("box").alias("i", "row"))
        .join(F.broadcast(starts), F.col("bucket") == F.col("of"))
        .select("row.*", slot.cast("long").alias("slot"), shard.cast("int").alias("shard"))
    )
    numbered.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    schema = T.StructType([f for f in numbered.schema.fields if f.name != "shard"]).add("shard", T.IntegerType())
    return spark.read.schema(schema).parquet(path)
