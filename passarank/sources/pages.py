"""Landed pages."""

from pyspark.sql import functions as F

from passarank.schemas import PAGE


def write_pages(pages, path):
    pages.write.mode("overwrite").parquet(path)


def read_pages(spark, path):
    """Pages stored as a table."""
    return spark.read.schema(PAGE).parquet(path)


def read_page_files(spark, path):
    """Saved page files, one row per file: ``page_id`` is the file name, ``html`` the whole text.

    A file of no bytes gives no row.
    """
    files = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
    return files.select(F.element_at(F.split("url", "/"), -1).alias("page_id"), "url", F.col("value").alias("html"))
