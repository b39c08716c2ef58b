import pytest
from pyspark.sql import functions as F
from tests.conftest import plan

from passarank.plans import sizing


def test_small_is_broadcast_and_large_is_not(spark):
    left = spark.range(1000).withColumnRenamed("id", "k")
    right = sizing.durable(left.withColumn("text", F.repeat(F.lit("x"), 100)))
    assert sizing.measured_bytes(right) >= 1000 * 100
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(left.join(sizing.small(right), "k"))
        assert "SortMergeJoin" in plan(left.join(sizing.small(right, limit=10_000), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nested_values_are_measured(spark):
    text = F.repeat(F.lit("x"), 100_000)
    stored = sizing.durable(spark.range(10).select(F.array(text).alias("a"), F.struct(text.alias("s")).alias("b"), F.create_map(F.lit("k"), text).alias("m")))
    assert 3_000_000 < sizing.measured_bytes(stored) < 3_100_000
    assert sizing.measured_bytes(stored.limit(0)) == 0


def test_durable_cuts_lineage_and_keeps_the_schema(spark):
    df = spark.range(10).select("id", F.struct("id").alias("s"), F.array("id").alias("a"))
    kept = sizing.durable(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.exceptAll(df).count() == 0
    assert "Range" not in plan(kept) and "FileScan" in plan(kept)


def test_only_small_inputs_are_dealt_out(spark):
    stored = sizing.durable(spark.range(100).coalesce(1))
    assert "RoundRobin" in plan(sizing.spread(stored))
    assert "RoundRobin" not in plan(sizing.spread(sizing.durable(spark.range(100, numPartitions=16))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    try:
        assert "RoundRobin" not in plan(sizing.spread(stored))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sizing.scratch_path(Session(), "x")
