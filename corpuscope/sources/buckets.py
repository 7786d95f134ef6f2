"""A keyed table in hash buckets, updated by copying only the buckets that a batch touches.

A bucket holds the rows whose key hash ends in a certain run of bits (``depth`` bits, value ``prefix``), as a
folder that is never changed. The manifest, one row per bucket, names the folder of each. An update reads the buckets
of its keys, writes them anew in a folder of its batch, and then a new version of the manifest: its cost grows with
the batch, not with the table. A bucket that gets more than ``rows`` rows is split on further bits as it is
rewritten, into ones of half as many or fewer on average, so buckets stay bounded and their number grows with the table.

A batch reads the manifest of its predecessor and writes its own, so running it again after a failure gives
the same table. Folders that neither of the two manifests names are deleted.

Only the manifest, and which buckets a batch touches, reach the driver: a number per ``rows`` rows of the table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from corpuscope.sources import versions

MANIFEST = "depth int, prefix bigint, batch bigint, n bigint"


@dataclass(frozen=True)
class Buckets:
    """One row per ``key``; ``columns`` is the schema, the key among them."""

    base: str
    key: str
    columns: str
    rows: int = 500_000

    def manifest(self, spark: SparkSession, batch: int | None = None) -> list[Row]:
        """The buckets, as they were before ``batch``; one empty bucket when there are none."""
        return sorted(_few(versions.read_before(spark, f"{self.base}/manifest", batch, MANIFEST))) or [Row(depth=0, prefix=0, batch=-1, n=0)]

    def read(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        return self._of(spark, self.manifest(spark, batch))

    def near(self, keys: DataFrame, batch: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys fall into."""
        spark = keys.sparkSession
        entries = self.manifest(spark, batch)
        return self._of(spark, self._touched(keys, entries))

    def upsert(self, changes: DataFrame, batch: int) -> None:
        """Put the rows of ``changes`` (one per key, none null) in the place of those with their key."""
        spark = changes.sparkSession
        entries = self.manifest(spark, batch)
        touched = self._touched(changes, entries)
        if not touched:
            return
        held = self._of(spark, touched)
        added = self._counted(changes.join(held.select(self.key), self.key, "left_anti"), entries)
        fresh = []
        for entry in touched:
            size = entry.n + added.get((entry.depth, entry.prefix), 0)
            more = math.ceil(math.log2(2 * size / self.rows)) if size > self.rows else 0
            fresh += [(entry.depth + more, entry.prefix + (i << entry.depth)) for i in range(1 << more)]
        old = held.join(changes.select(self.key), self.key, "left_anti")
        depth = max(d for d, _ in fresh)
        slots = [(slot, f"{d}-{p}") for d, p in fresh for slot in _slots(d, p, depth)]
        placed = old.unionByName(changes.select(*old.columns)).withColumn("slot", self._slot(depth)).join(
            spark.createDataFrame(slots, "slot bigint, bucket string"), "slot").drop("slot")
        folder = f"{self.base}/data/batch={batch}"
        placed.repartition(len(fresh), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        counted = spark.read.schema(f"{self.columns}, bucket string").parquet(folder).groupBy("bucket").agg(F.count("*").alias("n"))
        n = {row.bucket: row.n for row in _few(counted)}
        gone = {(entry.depth, entry.prefix) for entry in touched}
        kept = [tuple(entry) for entry in entries if (entry.depth, entry.prefix) not in gone]
        kept += [(d, p, batch if n.get(f"{d}-{p}") else -1, n.get(f"{d}-{p}", 0)) for d, p in fresh]
        versions.write_version(spark.createDataFrame(kept, MANIFEST).coalesce(1), f"{self.base}/manifest", batch + 1)
        self._prune(spark, batch, kept)

    def _of(self, spark: SparkSession, entries: list[Row]) -> DataFrame:
        folders = [f"{self.base}/data/batch={e.batch}/bucket={e.depth}-{e.prefix}" for e in entries if e.n]
        if not folders:
            return spark.createDataFrame([], self.columns)
        return spark.read.schema(self.columns).parquet(*folders)

    def _slot(self, depth: int) -> Column:
        return F.xxhash64(self.key).bitwiseAND(F.lit((1 << depth) - 1))

    def _counted(self, keys: DataFrame, entries: list[Row]) -> dict[tuple[int, int], int]:
        """How many of the keys fall into each bucket."""
        depth = max(entry.depth for entry in entries)
        slots = {row.slot: row.n for row in _few(keys.groupBy(self._slot(depth).alias("slot")).agg(F.count("*").alias("n")))}
        return {(e.depth, e.prefix): sum(slots.get(slot, 0) for slot in _slots(e.depth, e.prefix, depth)) for e in entries}

    def _touched(self, keys: DataFrame, entries: list[Row]) -> list[Row]:
        counted = self._counted(keys, entries)
        return [entry for entry in entries if counted[entry.depth, entry.prefix]]

    def _prune(self, spark: SparkSession, batch: int, now: list[tuple]) -> None:
        before = [tuple(entry) for entry in self.manifest(spark, batch)]
        kept = {(d, p, at) for d, p, at, _ in [*before, *now]}
        live = {at for _, _, at in kept}
        older = [n for n in versions.finished_versions(spark, f"{self.base}/manifest") if n <= batch][:-1]
        for version in older:
            for entry in _few(versions.read_before(spark, f"{self.base}/manifest", version, MANIFEST)):
                if entry.batch not in live:
                    versions.remove(spark, f"{self.base}/data/batch={entry.batch}")
                elif (entry.depth, entry.prefix, entry.batch) not in kept:
                    versions.remove(spark, f"{self.base}/data/batch={entry.batch}/bucket={entry.depth}-{entry.prefix}")
            versions.remove(spark, f"{self.base}/manifest/version={version}")


def _slots(depth: int, prefix: int, deepest: int) -> list[int]:
    """The values of ``deepest`` hash bits that belong to a bucket."""
    return [prefix + (i << depth) for i in range(1 << (deepest - depth))]


def _few(rows: DataFrame) -> list[Row]:
    """At most one row per bucket, as a list."""
    return rows.agg(F.collect_list(F.struct(*rows.columns)).alias("all")).first()["all"]
