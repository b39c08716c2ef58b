"""Stored tables that tasks read by themselves, one batch after another.

For work in which every task needs all rows of a table that fits no broadcast: the rows are stored once, in
order, and read in place as often as they are needed, instead of being moved to every task.
"""

import re

import pyarrow as pa
import pyarrow.parquet as pq

from passarank.plans.sizing import scratch_path, storing

# Row groups are small, as a task holds the raw columns of one.
GROUP_BYTES = 8 << 20
READ_ROWS = 8192


def open_folder(address):
    """``pyarrow``'s file system of a qualified address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", address).replace("s3a://", "s3://", 1))


class Ordered:
    """``df`` in the order of a column, stored in the shared folder; tasks get the files' addresses and their schema."""

    def __init__(self, df, order, name):
        spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
        with storing(spark):
            df.orderBy(order).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        self.files = sorted(spark.read.schema(df.schema).parquet(path).inputFiles(), key=lambda f: (int(re.search(r"part-(\d+)[^/]*$", f)[1]), f))
        self.schema = df.limit(0).toArrow().schema  # as Spark's own batches have it

    def tables(self, rows=READ_ROWS):
        """All rows in order, as tables of at most ``rows``."""
        for file in self.files:
            system, path = open_folder(file)
            with system.open_input_file(path) as opened:
                stored = pq.ParquetFile(opened, buffer_size=1 << 20)
                for batch in stored.iter_batches(rows, columns=self.schema.names, use_threads=False):
                    if batch.num_rows:
                        yield pa.Table.from_batches([batch]).select(self.schema.names).cast(self.schema)
