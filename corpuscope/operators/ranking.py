"""Exact row numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpuscope import session


def number_rows(df: DataFrame, group: str, order: str, buckets: int | None = None, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its ``group``, by ``order`` (equal orders come in any
    order).

    Rows are ranged by (group, order), so a group that holds most rows is spread over most ranges;
    how many there are follows from their size (adaptive execution merges small ones), or is given.
    Rows are numbered inside (group, range), and the counts of the group's earlier ranges are added.
    The cuts only balance the work: any cut gives the same numbers. The ranged rows are written once,
    so both uses see the same ranges."""
    cut = df.repartitionByRange(*([buckets] if buckets else []), group, order)
    ranged = session.written(cut.withColumn("rank_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "rank_range").agg(F.count("*").alias("rank_n"))
    earlier = Window.partitionBy(group).orderBy("rank_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("rank_group"), F.col("rank_range").alias("rank_at"),
        F.coalesce(F.sum("rank_n").over(earlier), F.lit(0)).alias("rank_before"))
    inside = Window.partitionBy(group, "rank_range").orderBy(order)
    numbered = ranged.withColumn("rank_inside", F.row_number().over(inside))
    return numbered.join(
        offsets, F.col(group).eqNullSafe(F.col("rank_group")) & (F.col("rank_range") == F.col("rank_at"))
    ).withColumn(name, F.col("rank_before") + F.col("rank_inside")).drop(
        "rank_range", "rank_inside", "rank_group", "rank_at", "rank_before")
