"""Nothing is cut, capped or left out because of its size, and searches fold every alphabet."""

import hashlib

from pyspark.sql import functions as F

from corpuscope import fixed
from corpuscope.operators import changes, lines, rollup, tags
from corpuscope.plans import sections
from corpuscope.sources import files as fl
from corpuscope.sources import ignore


def test_long_extensions_stay_whole(spark):
    row = spark.createDataFrame([("." + "x" * 3000, 1, 0)], "main_ext string, num_files int, num_dirs int")
    assert row.select(rollup.generated_purpose()).first()[0].endswith(" " + "x" * 3000 + " files")


def test_link_ids_hold_the_whole_digest(spark):
    row = spark.createDataFrame([("a/é.py",)], "p string").select(sections.file_id(F.col("p"))).first()
    assert row[0] == "file_" + hashlib.sha256("a/é.py".encode()).hexdigest()


def test_long_numeric_suffixes_are_reserved(spark):
    names = spark.createDataFrame([("t", 0), ("t-12345678901", 1), ("t", 2)], "name string, created_order bigint")
    assert [r.tag_id for r in tags.new_tag_ids(names).orderBy("created_order").collect()] == ["t", "t-12345678901", "t-1"]


def test_large_ignore_file(spark, tmp_path):
    rules = [f"path/number/{n}/{'x' * 200}" for n in range(fixed.MAX_FILE_BYTES // 200 + 10)]
    (tmp_path / ".gitignore").write_text("\n".join(rules))
    assert (tmp_path / ".gitignore").stat().st_size > fixed.MAX_FILE_BYTES
    assert ignore.read_rules(spark, str(tmp_path)).count() == len(rules)


def test_blank_and_empty_files_stay_in_reports(make_files):
    files = make_files({"blank.txt": "\n" * 3000, "empty.txt": "", "full.txt": "text"})
    for report in (sections.document_plaintext, sections.document_markdown, sections.document_html, sections.tree_markdown, sections.tree_html):
        assert {r.relative_path for r in report(files).collect()} == {"blank.txt", "empty.txt", "full.txt"}, report.__name__


def test_search_folds_other_alphabets(make_files):
    found = lines.search_regex(make_files({"a": "une École\nzwei\necole", "b": "ÜBER"}), "école|über")
    assert sorted(r.text for r in found.collect()) == ["une École", "ÜBER"]


def test_snapshots_compare_the_real_analysis(make_files):
    old, new = (make_files({"a.ts": f"import x from './{x}'\n", "b.ts": "let a = 1;"}) for x in "pq")
    wide = [f.withColumns(fl.analysis_columns(F.col("content"))) for f in (old, new)]
    rows = {r.relative_path: (r.change_type, r.analysis_changed) for r in changes.compare_snapshots(*wide).collect()}
    assert rows["a.ts"] == ("modified", True) and rows["b.ts"] == ("unchanged", False)
    same = {r.relative_path: r.analysis_changed for r in changes.compare_snapshots(wide[0], wide[0]).collect()}
    assert not any(same.values())


def test_language_stats_count_all_files(spark):
    from workload.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    total = {r.language: r.n_files for r in QUERIES["language_stats"](spark, folder).collect()}["(all)"]
    assert total == spark.read.parquet(f"{folder}/documents.parquet").count()
