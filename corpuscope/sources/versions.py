"""Small versioned tables: each write is a new folder, the newest finished one is read.

A table that is read is never overwritten, so a job that fails or an executor that is lost
leaves the last version as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all it holds."""
    fs, folder = _folder(spark, path)
    return fs.delete(folder, True)


def folder_names(spark: SparkSession, base: str) -> list[str]:
    """Names of the folders directly below ``base``; none when there is no such folder."""
    fs, folder = _folder(spark, base)
    if not fs.exists(folder):
        return []
    return [e.getPath().getName() for e in fs.listStatus(folder) if e.isDirectory()]


def last_written(spark: SparkSession, path: str) -> float:
    """Seconds since the epoch of the newest change of a folder or of what lies directly in it."""
    fs, folder = _folder(spark, path)
    times = [fs.getFileStatus(folder).getModificationTime()]
    return max(times + [e.getModificationTime() for e in fs.listStatus(folder)]) / 1000


def finished_versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the versions whose write has been committed, ascending."""
    fs, folder = _folder(spark, base)
    if not fs.exists(folder):
        return []
    done = []
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("version=") and fs.exists(_folder(spark, f"{base}/{name}/_SUCCESS")[1]):
            done.append(int(name.removeprefix("version=")))
    return sorted(done)


def read_latest(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The newest finished version; an empty table when there is none."""
    done = finished_versions(spark, base)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/version={done[-1]}")


def read_before(spark: SparkSession, base: str, batch: int | None, schema: str) -> DataFrame:
    """The newest version that batches before ``batch`` have written (batch n writes version n + 1; no batch: the newest)."""
    done = [n for n in finished_versions(spark, base) if batch is None or n <= batch]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/version={done[-1]}")


def drop_before(spark: SparkSession, base: str, batch: int) -> None:
    """Delete the versions that neither ``batch`` nor a later one reads."""
    done = [n for n in finished_versions(spark, base) if n <= batch]
    for version in done[:-1]:
        remove(spark, f"{base}/version={version}")


def write_version(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write the next version, or a given one. Writing a given version twice replaces it with
    the same content, which makes a repeated batch harmless."""
    done = finished_versions(df.sparkSession, base)
    number = version if version is not None else (done[-1] + 1 if done else 0)
    df.write.mode("overwrite").parquet(f"{base}/version={number}")
    return number
