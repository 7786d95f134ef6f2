"""Seconds per headline query on local[$BENCH_CPUS] over $BENCH_SF_DIR, as one JSON line.

Every query runs to its end into Spark's no-op sink, so all rows and columns are computed and
none reach the driver. The first query also runs once before the timing starts. ``BENCH_QUERIES`` (comma separated, or ``all``) picks others."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

HEADLINE = [
    "language_stats", "word_counts", "file_purpose", "cyclomatic", "cognitive", "search_regex",
    "chunk_lines", "chunk_chars", "sensitive_matches", "redact", "code_symbols", "import_edges",
    "resolve_imports", "cross_references", "track_changes", "snapshot_diff", "line_diff",
    "directory_summary", "inherited_tags", "toc_entries", "render_markdown", "render_html",
    "render_plaintext", "latest_version", "stream_language_stats",
]


def run(spark: SparkSession, name: str, folder: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    run(spark, names[0], folder)  # untimed: class loading and the first compilation
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(spark, name, folder)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
