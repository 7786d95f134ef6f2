"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpuscope.sources import versions

# Run-time settings the operators count on. Skewed join partitions are split by size while
# the query runs, also where that costs one more shuffle. No operator hints a broadcast: Spark
# broadcasts a side only when its size, taken from its files and counted four times for their
# compression, or measured while the query runs, is below the threshold; any larger side is
# shuffled.
RUNTIME_SETTINGS = {
    "spark.sql.sources.fileCompressionFactor": "4.0",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Exploded arrays are costly expressions here; this rule would compute each of them a second
    # time, in a filter on its size.
    "spark.sql.optimizer.excludedRules":
        "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets a fresh folder of
    its own. On a cluster a missing setting is an error, never a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpuscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a small input among all cores, by a unique key. Input that comes in at least as
    many splits as there are cores, as any large one does, is returned as it is: unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder. Used for slim sets of keys before they meet a
    table with contents: the set is computed once, its size is known when the join is planned, so
    a small one is broadcast and no content is shuffled, and a large one is not broadcast."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# Shuffle files of a finished query are of no use where each step writes its result; Spark else keeps them until the
# driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``written`` whose tables are deleted at the end of the block, for steps between an input and a result that
    is written itself."""
    folders = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        folders.append(new_folder(spark, label))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    try:
        yield keep
    finally:
        for folder in folders:
            versions.remove(spark, folder)
