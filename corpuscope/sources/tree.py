"""Directory trees with their hidden files.

Spark's own file sources leave out names that start with a dot or an underscore, so notes
directories, ignore files and other dot files need a listing of their own. Directories are
listed level by level in tasks, each level a written table; contents are read in tasks too.
The driver holds neither the listing nor any content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope import fixed, session

_LISTED = "relative_path string, is_dir boolean, size bigint, mtime timestamp"
_READ = "relative_path string, size bigint, mtime timestamp, bytes binary"
# Contents handed to Spark at once by a reading task.
_BATCH_BYTES = 32 * 1024 * 1024


def _filesystem(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def list_tree(spark: SparkSession, root: str, skip_pattern: str | None = None) -> DataFrame:
    """(relative_path, is_dir, size, mtime) of everything below ``root``. Directories whose path
    (with a final slash) matches ``skip_pattern`` are not entered."""
    folder = session.new_folder(spark, "listing")

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        filesystem, base = _filesystem(root)
        base = base.rstrip("/")
        for batch in batches:
            for directory in batch["relative_path"]:
                where = f"{base}/{directory}" if directory else base
                found = filesystem.get_file_info(fs.FileSelector(where))
                yield pd.DataFrame({
                    "relative_path": [f.path[len(base) + 1:] for f in found],
                    "is_dir": [f.type == fs.FileType.Directory for f in found],
                    "size": [f.size or 0 for f in found],
                    "mtime": pd.to_datetime([f.mtime_ns or 0 for f in found], unit="ns", utc=True).floor("us"),
                }).astype({"relative_path": "object", "is_dir": "bool", "size": "int64"})

    level, depth = spark.createDataFrame([("",)], "relative_path string"), 0
    while True:
        level.repartition("relative_path").mapInPandas(children, _LISTED).write.parquet(
            f"{folder}/depth={depth}")
        written = spark.read.schema(_LISTED).parquet(f"{folder}/depth={depth}")
        level = written.filter("is_dir").select("relative_path")
        if skip_pattern:
            level = level.filter(~F.concat("relative_path", F.lit("/")).rlike(skip_pattern))
        if level.isEmpty():
            break
        depth += 1
    return spark.read.schema(_LISTED).parquet(*[f"{folder}/depth={d}" for d in range(depth + 1)])


def read_bytes(listed: DataFrame, root: str, max_bytes: int | None = None) -> DataFrame:
    """Add ``bytes`` to listed files (apply path filters to the listing first). A file above ``max_bytes``
    is not opened; it stays in the table with null ``bytes``."""

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _filesystem(root)
        base = base.rstrip("/")
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                data = None
                if max_bytes is None or row.size <= max_bytes:
                    with filesystem.open_input_stream(f"{base}/{row.relative_path}") as stream:
                        data = stream.read()
                    held += len(data)
                rows.append((row.relative_path, row.size, row.mtime, data))
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["relative_path", "size", "mtime", "bytes"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["relative_path", "size", "mtime", "bytes"])

    files = listed.filter("not is_dir").select("relative_path", "size", "mtime")
    return files.repartition("relative_path").mapInPandas(contents, _READ)


# Ignored directories need not be entered at all.
SKIPPED_DIRECTORIES = "|".join(f"(?:{p})" for p in fixed.TREE_IGNORE_PATTERNS if not p.endswith("$"))
