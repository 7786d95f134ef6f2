"""Snapshots: a small header table and the files of each snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope import fixed, schema
from corpuscope.sources import versions

ORPHAN_SECONDS = 24 * 3600.0    # after this long without a write, files without a header are of a failed run
PAGE = 1000                     # folders deleted per query


def snapshot_stats(snapshot_files: DataFrame) -> DataFrame:
    """(snapshot_id, total_files, total_size) and per language in ``language_breakdown``."""
    per_language = snapshot_files.groupBy("snapshot_id", "language").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"))
    return per_language.groupBy("snapshot_id").agg(
        F.sum("n").alias("total_files"), F.sum("size").alias("total_size"))


def language_breakdown(snapshot_files: DataFrame) -> DataFrame:
    return snapshot_files.groupBy("snapshot_id", "language").agg(F.count("*").alias("n_files"))


def newest(headers: DataFrame, keep: int = fixed.MAX_SNAPSHOTS) -> DataFrame:
    """The newest ``keep`` headers: a top-k, taken per task first."""
    return headers.orderBy(F.col("ts").desc(), F.col("snapshot_id").desc()).limit(keep)


def deleted(headers: DataFrame, ids: DataFrame) -> DataFrame:
    return headers.join(ids.select("snapshot_id"), "snapshot_id", "left_anti")


def updated(headers: DataFrame, changes: DataFrame) -> DataFrame:
    """Headers with new ``description`` / ``tags`` where ``changes`` (snapshot_id, description,
    tags) gives one; null keeps the old value."""
    new = changes.select(
        "snapshot_id", F.col("description").alias("_description"), F.col("tags").alias("_tags"))
    return headers.join(new, "snapshot_id", "left").select(
        "snapshot_id", "ts", F.coalesce("_description", "description").alias("description"),
        F.coalesce("_tags", "tags").alias("tags"))


class SnapshotStore:
    """Headers as a versioned table; files appended as one partition per snapshot."""

    def __init__(self, spark: SparkSession, base: str, keep: int = fixed.MAX_SNAPSHOTS):
        self.spark, self.base, self.keep = spark, base.rstrip("/"), keep

    def headers(self) -> DataFrame:
        return versions.read_latest(self.spark, f"{self.base}/headers", schema.SNAPSHOTS)

    def files(self, snapshot_id: str) -> DataFrame:
        """Files of one snapshot; only its folder is read."""
        return self.spark.read.parquet(f"{self.base}/files/snapshot_id={snapshot_id}").withColumn(
            "snapshot_id", F.lit(snapshot_id))

    def get(self, snapshot_id: str) -> DataFrame:
        return self.headers().filter(F.col("snapshot_id") == snapshot_id)

    def create(self, files: DataFrame, snapshot_id: str, ts, description: str | None = None,
               tags: list[str] | None = None) -> None:
        """Files first, header last: a snapshot is visible only when it is complete."""
        files.write.mode("overwrite").parquet(f"{self.base}/files/snapshot_id={snapshot_id}")
        row = self.spark.createDataFrame([(snapshot_id, ts, description, tags)], schema.SNAPSHOTS)
        self._replace(newest(self.headers().unionByName(row), self.keep), snapshot_id)

    def delete(self, snapshot_id: str) -> bool:
        before = self.headers()
        if before.filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            return False
        self._replace(before.filter(F.col("snapshot_id") != snapshot_id))
        return True

    def update(self, snapshot_id: str, description: str | None = None,
               tags: list[str] | None = None) -> bool:
        if self.get(snapshot_id).isEmpty():
            return False
        change = self.spark.createDataFrame(
            [(snapshot_id, description, tags)], "snapshot_id string, description string, tags array<string>")
        self._replace(updated(self.headers(), change))
        return True

    def stored(self) -> DataFrame:
        """(snapshot_id) of every folder of files, whether or not a header names it."""
        names = versions.folder_names(self.spark, f"{self.base}/files")
        ids = [(n.removeprefix("snapshot_id="),) for n in names if n.startswith("snapshot_id=")]
        return self.spark.createDataFrame(ids, "snapshot_id string")

    def orphans(self) -> DataFrame:
        """Folders without a header: of runs that failed before their header, or while they freed files."""
        return deleted(self.stored(), self.headers())

    def sweep(self, grace_seconds: float = ORPHAN_SECONDS) -> int:
        """Delete the files of orphans that nothing was written to for ``grace_seconds`` (a run that still
        writes has no header yet); the number of folders deleted."""
        oldest = time.time() - grace_seconds
        return self._free(self.orphans(), lambda path: versions.last_written(self.spark, path) <= oldest)

    def _replace(self, headers: DataFrame, *created: str) -> None:
        """Commit the headers, then free the files of the snapshots that are no longer named, however many
        an earlier ``keep`` allowed: a run that ends in between leaves files too many, which the next sweep
        finds, never a header without files."""
        before = self.headers().select("snapshot_id")
        if created:
            before = before.unionByName(self.spark.createDataFrame([(c,) for c in created], "snapshot_id string"))
        versions.write_version(headers, f"{self.base}/headers")
        self._free(deleted(before.distinct(), self.headers()))

    def _free(self, ids: DataFrame, may_go: Callable[[str], bool] = lambda path: True) -> int:
        """Delete folders page by page of their sorted ids, so the driver never holds all of them."""
        freed, page = 0, ids.orderBy("snapshot_id").limit(PAGE)
        while rows := page.take(PAGE):
            paths = [f"{self.base}/files/snapshot_id={row['snapshot_id']}" for row in rows]
            freed += sum(versions.remove(self.spark, path) for path in paths if may_go(path))
            page = ids.filter(F.col("snapshot_id") > rows[-1]["snapshot_id"]).orderBy("snapshot_id").limit(PAGE)
        return freed


def save_named(stored: DataFrame, saves: DataFrame) -> DataFrame:
    """Upsert (name, content, ts): a saved name replaces the stored one."""
    return stored.join(saves.select("name"), "name", "left_anti").unionByName(saves.select(*stored.columns))


def list_named(stored: DataFrame) -> DataFrame:
    return stored.select("name").distinct().orderBy("name")


def load_named(stored: DataFrame, name: str) -> DataFrame:
    return stored.filter(F.col("name") == name).select("content")


def delete_named(stored: DataFrame, names: DataFrame) -> DataFrame:
    return stored.join(names.select("name"), "name", "left_anti")
