"""State between runs: path -> hash, tags, and the sink of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope import schema, session
from corpuscope.sources import versions


def load_state(spark: SparkSession, base: str) -> DataFrame:
    """(relative_path, content_hash) of the last finished run; empty when there is none."""
    return versions.read_latest(spark, base, schema.STATE)


def save_state(files: DataFrame, base: str) -> int:
    return versions.write_version(files.select("relative_path", "content_hash"), base)


def load_tags(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tags, applied tags, inheritance settings); defaults when nothing was saved."""
    tags = versions.read_latest(spark, f"{base}/tags", schema.TAGS)
    applied = versions.read_latest(spark, f"{base}/applied_tags", schema.APPLIED_TAGS)
    settings = versions.read_latest(spark, f"{base}/inheritance", schema.INHERITANCE)
    if not versions.finished_versions(spark, f"{base}/inheritance"):
        settings = spark.createDataFrame([(True, False)], schema.INHERITANCE)
    return tags, applied, settings


def save_tags(tags: DataFrame, applied: DataFrame, base: str, enabled: bool = True,
              override: bool = False) -> None:
    spark = tags.sparkSession
    versions.write_version(tags.select(*schema.names(schema.TAGS)), f"{base}/tags")
    versions.write_version(applied.select(*schema.names(schema.APPLIED_TAGS)), f"{base}/applied_tags")
    versions.write_version(
        spark.createDataFrame([(enabled, override)], schema.INHERITANCE), f"{base}/inheritance")


def read_tag_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tags and applied tags of a JSON configuration file (``tags`` list, ``appliedTags`` map)."""
    loaded = spark.read.schema(
        "tags array<struct<id:string,name:string,color:string,description:string,scope:string,icon:string>>, "
        "appliedTags map<string,array<struct<id:string,appliedTo:string,appliedAt:string,appliedBy:string>>>"
    ).json(path, multiLine=True)
    tags = loaded.select(F.inline("tags")).withColumnRenamed("id", "tag_id").select(*schema.names(schema.TAGS))
    applied = loaded.select(F.explode("appliedTags").alias("target", "held")).select(
        "target", F.inline("held")).select(
        F.col("id").alias("tag_id"), F.coalesce("appliedTo", "target").alias("applied_to"),
        F.to_timestamp("appliedAt").alias("applied_at"), F.col("appliedBy").alias("applied_by"))
    return tags, applied


FILE_BYTES = 128 * 1024 * 1024  # aimed at per file of a report


def write_report(parts: DataFrame, path: str, order: list[str], text: str = "text",
                 partitions: int | None = None, file_bytes: int = FILE_BYTES) -> int:
    """Write report parts as text files whose names follow the order of the parts; the number of files
    asked for. Rows are ranged by the whole key, so one huge file or section is split over several
    output files.

    The parts are staged with their sizes first. A range exchange looks at its input twice (once for its
    bounds), so without that every part would be rendered twice; and the sizes alone, one slim column, tell
    how many files the report needs."""
    spark = parts.sparkSession
    with session.scratch(spark) as keep:
        rendered = keep(parts.select(*order, F.col(text).alias("part_text"), (F.coalesce(
            F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("part_bytes")), "parts")
        total = rendered.agg(F.sum("part_bytes").alias("n")).first()["n"] or 0
        n = partitions or max(1, -(-total // file_bytes))
        rendered.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
            F.col("part_text").alias("value")).write.text(path)
    return n
