"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope import session

# Words of the word-based operators: runs of anything but ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def configure(spark: SparkSession, batch_rows: int = 500, clean: bool = False) -> SparkSession:
    """The library's settings, and Arrow batches small enough that a batch of long texts and the
    arrays made of it stay a small part of an executor's memory. ``clean``: shuffle files go at the end of each query."""
    spark.conf.set(session.CLEAN_SHUFFLES, str(clean).lower())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return session.configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")


def crc32_long(data: Column) -> Column:
    return F.crc32(data).cast("long")
