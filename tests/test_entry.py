import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

ROOT = pathlib.Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"
QUICK = ["language_stats", "file_purpose", "chunk_chars", "sensitive_matches", "redact", "code_symbols", "cross_references",
         "snapshot_diff", "line_diff", "directory_summary", "inherited_tags", "render_markdown", "render_plaintext",
         "tag_ids", "stream_incremental"]


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) - set(entry.ORACLES) == {"scan_files"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_twin(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER)
    twin = duck.sql(entry.oracle_sql()[name])
    assert rows_of(result.columns, [tuple(r) for r in result.collect()]) == rows_of(list(twin.columns), twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["relative_path", "part_no", "text"]


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["filter_builtin_ignore"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string>" in plan


def test_no_forced_broadcast_cross_join_or_driver_collection():
    """The library never hints a broadcast, crosses tables, or pulls rows to the driver."""
    banned = {"broadcast", "crossJoin", "collect", "toPandas", "toLocalIterator", "localCheckpoint"}
    for path in (ROOT / "corpuscope").rglob("*.py"):
        if "llm" in path.parts:  # has tests of its own
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in banned, (path, node.lineno, node.attr)
