"""Order of files in listings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def by_path(files: DataFrame) -> DataFrame:
    """Binary order of the path; a range-partitioned sort."""
    return files.orderBy("relative_path")


def by_user_order(files: DataFrame, order: DataFrame) -> DataFrame:
    """Files with a rank first, in that order; the others after them by path. ``order`` has
    (relative_path, rank), one row per path."""
    return files.join(order.select("relative_path", "rank"), "relative_path", "left").orderBy(
        F.col("rank").asc_nulls_last(), "relative_path")
