"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuscope import session


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame, written=session.written) -> DataFrame:
    """node, component (its smallest node) of every node that has a link in ``edges`` (a, b).

    Alternating stars: every node hangs its larger neighbours, then all its smaller ones, on the smallest
    node it sees, until nothing changes; the rounds grow with the logarithm of the number of nodes. Minima are
    taken per task before they move, and each round is a written table, so lineage stays short."""
    links = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).withColumn("low", F.least("low", "a"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = _lowest(large)  # every link points to a smaller node here
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                              F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        fresh = written(small, "links")
        if _mark(fresh) == _mark(links):
            return fresh.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                fresh.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        links = fresh


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
