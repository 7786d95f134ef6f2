"""Streams of edits: one row per edit of a file (path, ts, content_hash, ...).

The last edit of a path counts, by time and then hash (``reuse.version_rank``), whatever the order in which edits
arrive. An edit without a hash removes the file. State is kept in hash buckets (``sources.buckets``) or in Spark's state
store; a micro-batch reads and writes the part of it that its paths touch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscope import schema, session
from corpuscope.operators import changes, filters, reuse, rollup
from corpuscope.sources import versions
from corpuscope.sources.buckets import Buckets

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State has one row per path, so it is kept outside the heap."""
    spark.conf.set(_PROVIDER, ROCKSDB)


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process what is available, then stop. The checkpoint lies in the shared folder."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


# --- change feed ---------------------------------------------------------------------------------


def collapsed(edits: DataFrame, key: str = "path", at: str = "at", content: str = "content_hash") -> DataFrame:
    """The last edit per path within each Arrow batch, so that a path with most of the edits reaches its state as a
    few rows, without a shuffle."""

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values([at, content], kind="stable", na_position="first").drop_duplicates(key, keep="last")

    return edits.mapInPandas(last, edits.schema)


_FEED = "path string, ts timestamp, change_type string, old_hash string, new_hash string"
_CHANGE = "path string, at bigint, change_type string, old_hash string, new_hash string"
_STATE = "at bigint, content_hash string"


def _rank(at: int, content_hash: str | None) -> tuple:
    return at, content_hash is not None, content_hash or ""


class ChangeFeed(StatefulProcessor):
    """Per path the time (microseconds) and hash of its last edit; a removed path keeps the time, so that older edits stay
    ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(initialState.at, initialState.content_hash)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, new = max(((row.at, row.content_hash) for row in rows), key=lambda edit: _rank(*edit))
        known = self.last.exists()
        before, old = self.last.get() if known else (None, None)
        if known and _rank(at, new) <= _rank(before, old):
            return
        self.last.update((at, new))
        if new != old:
            kind = "added" if old is None else "removed" if new is None else "modified"
            yield Row(path=key[0], at=at, change_type=kind, old_hash=old, new_hash=new)

    def _keep(self, at: int, content_hash: str | None) -> None:
        """Of several rows of a path in a snapshot, the last."""
        if not self.last.exists() or _rank(at, content_hash) > _rank(*self.last.get()):
            self.last.update((at, content_hash))

    def close(self) -> None:
        pass


def change_feed(edits: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Added / modified / removed per path against the last known edit. The state is one row per path; it starts from
    ``snapshot`` (path, ts, content_hash) in the first run of a checkpoint. An edit that is not later than the state is
    ignored, and of the edits of a micro-batch the last counts, so their order makes no difference."""
    def timed(rows: DataFrame) -> DataFrame:
        return rows.select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "content_hash")

    start = None if snapshot is None else reuse.latest_versions(timed(snapshot), at="at").groupBy("path")
    found = collapsed(timed(edits)).groupBy("path").transformWithState(ChangeFeed(), _CHANGE, "Append", "None", start)
    return found.select("path", F.timestamp_micros("at").alias("ts"), "change_type", "old_hash", "new_hash")


def write_change_feed(edits: DataFrame, base: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Run the change feed into a table below ``base`` and return that table."""
    keep_state_on_disk(edits.sparkSession)
    feed = change_feed(edits, snapshot)

    def write(rows: DataFrame, batch_id: int) -> None:
        versions.write_version(rows, f"{base}/feed", batch_id)

    run(feed, f"{base}/checkpoint", write)
    return feed_table(edits.sparkSession, base)


def feed_table(spark: SparkSession, base: str) -> DataFrame:
    return _all_versions(spark, f"{base}/feed", _FEED)


def _all_versions(spark: SparkSession, base: str, columns: str) -> DataFrame:
    done = versions.finished_versions(spark, base)
    if not done:
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(*[f"{base}/version={n}" for n in done])


# --- statistics that follow edits ----------------------------------------------------------------------

_LATEST = "path string, ts timestamp, content_hash string, language string, size bigint"
_COUNTS = "language string, n bigint, b bigint"


def latest_edits(base: str, rows: int = 500_000) -> Buckets:
    """The last edit of every path, removals included."""
    return Buckets(f"{base}/latest", "path", _LATEST, rows)


def refresh_language_stats(edits: DataFrame, base: str, bucket_rows: int = 500_000) -> DataFrame:
    """Language statistics that follow edits. Counts are taken back and added: a path that is edited again loses its
    old row in the counts and gets its new one. A micro-batch reads the buckets of its paths and one row per language."""
    spark = edits.sparkSession
    paths = latest_edits(base, bucket_rows)

    def step(rows: DataFrame, batch_id: int) -> None:
        coming = reuse.latest_versions(rows.select(*schema.names(_LATEST)).where("path IS NOT NULL"))
        coming = session.written(coming, "coming")
        old = paths.near(coming, batch_id).select("path", F.struct(*schema.names(_LATEST)[1:]).alias("old"))
        both = coming.join(old, "path", "left").where(
            F.col("old").isNull() | (reuse.version_rank() > reuse.version_rank(of="old.")))
        newer = session.written(both, "newer")
        added = newer.where("content_hash IS NOT NULL").select("language", F.lit(1).alias("n"), "size")
        taken = newer.where("old.content_hash IS NOT NULL").select("old.language", F.lit(-1).alias("n"), (-F.col("old.size")).alias("size"))
        delta = added.unionByName(taken).groupBy("language").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
        before = versions.read_before(rows.sparkSession, f"{base}/counts", batch_id, _COUNTS)
        counts = before.unionByName(delta).groupBy("language").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        versions.write_version(counts.where("n <> 0"), f"{base}/counts", batch_id + 1)
        versions.drop_before(rows.sparkSession, f"{base}/counts", batch_id)
        paths.upsert(newer.drop("old"), batch_id)

    run(edits, f"{base}/checkpoint", step)
    return rollup.with_total(versions.read_before(spark, f"{base}/counts", None, _COUNTS))


# --- incremental runs -------------------------------------------------------------------------------------


def known_contents(base: str, rows: int = 500_000) -> Buckets:
    """path -> hash of what incremental runs have processed."""
    return Buckets(f"{base}/state", "relative_path", schema.STATE, rows)


def start_incremental(state: DataFrame, base: str, bucket_rows: int = 500_000) -> None:
    """Begin with the paths and hashes of an earlier run."""
    known_contents(base, bucket_rows).upsert(state.select(*schema.names(schema.STATE)), -1)


def incremental_run(edits: DataFrame, base: str, process: Callable[[DataFrame], DataFrame], bucket_rows: int = 500_000) -> None:
    """Process only new contents and keep path -> hash between runs.

    Each micro-batch compares its last edits with the buckets of their paths, writes the results, then those
    buckets. Both carry the number of the batch, so a batch that is run again after a failure writes
    the same tables again."""
    known = known_contents(base, bucket_rows)

    def step(rows: DataFrame, batch_id: int) -> None:
        edits_only = rows.select("relative_path", "ts", "content_hash")
        last = session.written(reuse.latest_versions(edits_only, "relative_path", "ts"), "last")
        state = known.near(last, batch_id)
        fresh = session.written(filters.changed_since(last, state), "fresh")
        before = state.join(fresh.select("relative_path"), "relative_path", "left_semi")
        kinds = changes.track_changes(before, fresh)
        kept = rows.join(fresh, ["relative_path", "ts", "content_hash"], "left_semi").dropDuplicates(["relative_path"])
        results = process(kept).join(kinds.select("relative_path", "change_type"), "relative_path")
        versions.write_version(results, f"{base}/results", batch_id)
        known.upsert(fresh.select(*schema.names(schema.STATE)), batch_id)

    run(edits, f"{base}/checkpoint", step)


def incremental_results(spark: SparkSession, base: str, columns: str) -> DataFrame:
    return _all_versions(spark, f"{base}/results", columns)
