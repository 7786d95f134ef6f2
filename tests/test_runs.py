import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscope import schema, session
from corpuscope.operators import snapshots
from corpuscope.options import PRESETS, ReportOptions, preset
from corpuscope.plans import aggregate, sections, toc
from corpuscope.sources import files as fl
from corpuscope.sources import state, tree, versions


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "project"
    contents = {
        "main.py": '"""Entry."""\nimport utils\n\ndef main():\n    pass\n', "utils.py": "def helper():\n    return 1\n",
        "config/settings.py": "DEBUG = True\n", "config/.notes/settings.py": "Settings note", "main.py.notes": "Main note",
        ".gitignore": "*.tmp\n/skip/\n", "x.tmp": "no", "skip/y.py": "no", "node_modules/z.js": "no", "image.png": "no",
        "a b+c%20/ü.md": "# Titel\n", "_under.py": "u = 1\n", "big.txt": "x" * 2000,
    }
    for path, content in contents.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    (root / "binary.txt").write_bytes(b"\xff\xfe\x00bad")
    return root


def _report(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return "".join(open(os.path.join(path, n)).read() for n in names)


def test_listing_has_hidden_names_and_skips_ignored_directories(spark, project):
    listed = tree.list_tree(spark, str(project), tree.SKIPPED_DIRECTORIES)
    names = {r.relative_path for r in listed.filter("not is_dir").collect()}
    assert {".gitignore", "config/.notes/settings.py", "_under.py", "a b+c%20/ü.md"} <= names and "node_modules/z.js" not in names


def test_fast_scan_reads_visible_files_below_the_limit(spark, project):
    rows = {r.relative_path: r.size for r in fl.scan_tree(spark, str(project), max_bytes=1000).collect()}
    assert rows["main.py"] == 48 and "big.txt" not in rows and "a b+c%20/ü.md" in rows and ".gitignore" not in rows
    plan = fl.scan_tree(spark, str(project), max_bytes=1000).select("relative_path")._jdf.queryExecution().toString()
    assert "PushedFilters: [LessThanOrEqual(length,1000)]" in plan or "LessThanOrEqual(length,1000)" in plan


def test_tree_files(spark, project):
    files, rejects = aggregate.tree_files(spark, str(project), max_bytes=1000)
    rows = {r.relative_path: r for r in files.collect()}
    assert set(rows) == {"main.py", "utils.py", "config/settings.py", "config/.notes/settings.py", "main.py.notes", ".gitignore",
                         "a b+c%20/ü.md", "_under.py"}
    assert rows["main.py"].user_summary == "Main note" and rows["config/settings.py"].user_summary == "Settings note"
    assert [r.relative_path for r in rejects.collect()] == ["binary.txt"]
    kept, _ = aggregate.tree_files(spark, str(project), exclude_dirs=["config", "_"], max_bytes=1000)
    assert not {"config/settings.py", "_under.py"} & {r.relative_path for r in kept.collect()}


def test_runs_track_changes_and_write_ordered_reports(spark, project, tmp_path):
    store = str(tmp_path / "store")
    first = aggregate.aggregate_tree(spark, str(project), str(tmp_path / "out1"), store, max_bytes=1000)
    text = _report(tmp_path / "out1")
    assert text.index("### Added Files") < text.index("- [main.py](#main-py) - Entry.") < text.index("## main.py {main-py}")
    assert text.index("## _under.py") < text.index("## main.py") < text.index("## utils.py")
    assert "Main note" in text and "main (Lines 4-5)" in text and first is not None
    (project / "main.py").write_text("print('v2')\n")
    (project / "utils.py").unlink()
    aggregate.aggregate_tree(spark, str(project), str(tmp_path / "out2"), store, incremental=True, max_bytes=1000)
    text = _report(tmp_path / "out2")
    assert "- main.py (modified)" in text and "- utils.py (removed)" in text and "## settings.py" not in text
    aggregate.aggregate_tree(spark, str(project), str(tmp_path / "out3"), store, style="html", max_bytes=1000)
    html = _report(tmp_path / "out3")
    assert "changes-section" not in html and "<h2>main.py</h2>" in html


def test_document_run(make_files):
    files = make_files({"src/a.ts": "'use client'; const x = React;", "src/b.env": "K=1", "src/node_modules/c.js": "x", "d.png": "", "e.md": "# E"})
    kept = aggregate.selected_documents(files, exclude=["md"])
    assert [r.relative_path for r in kept.collect()] == ["src/a.ts"]
    rows = aggregate.document_report(kept, "text").orderBy("part", "relative_path", "part_no").collect()
    assert rows[0].text == "\n[src]" and rows[1].text.startswith("  a.ts (Client Component | Frameworks: React)")
    assert "File: src/a.ts" in rows[2].text and "```ts\n'use client'" in rows[2].text
    for style in ("markdown", "html"):
        assert aggregate.document_report(kept, style).count() == 3
        assert toc.toc_by_directory(kept, style).count() == 2


def test_document_run_with_references(make_files):
    from corpuscope.operators import xref
    files = make_files({"a.ts": "import { b } from './b';", "b.ts": "x"})
    refs = xref.cross_references(xref.resolve_imports(xref.import_edges(files), files))
    report = aggregate.document_report(files, "markdown", ReportOptions(depth="detailed"), refs)
    rows = report.orderBy("part", "relative_path", "part_no", "detail").collect()
    assert [r.text for r in rows if r.detail] == ["References:", "- → `b.ts` (b) - Line 1", "Referenced By:", "- ← `a.ts` (b) - Line 1"]
    assert aggregate.document_report(files, "text", ReportOptions(), refs).filter("detail <> ''").count() == 0


def test_depth_decides_what_is_computed(make_files):
    files = make_files({"a.ts": "import x from 'y'"})
    assert sections.summary_rows(files, ReportOptions(depth="minimal")).columns == ["relative_path", "purpose"]
    assert sections.summary_rows(files, PRESETS["development"]).columns[-1] == "security"
    assert "exports" not in sections.summary_rows(files, preset("detailed", exports=False)).columns
    with pytest.raises(ValueError):
        ReportOptions(depth="deep")


def test_key_points_and_summaries_pass_through(spark, make_files):
    files = make_files({"a.ts": "x"}).withColumn("ai_summary", F.lit("Sum")).withColumn(
        "key_points", F.array(*[F.lit(f"p{i} - sub{i}") for i in range(4)]))
    plain = sections.document_plaintext(files, ReportOptions(depth="basic")).first().text
    assert "Summary: Sum\nKey Points:\n  • p0 - sub0\n  • p1 - sub1\n" in plain and "p2" not in plain
    full = sections.document_markdown(files, ReportOptions(depth="comprehensive")).first().text
    assert "- p3\n  - sub3" in full
    assert "<li>p0\n<ul>\n<li>sub0</li>\n</ul>\n</li>" in sections.document_html(files, ReportOptions(depth="comprehensive")).first().text
    assert "Key Points" not in sections.document_plaintext(files, ReportOptions(depth="minimal")).first().text


def test_toc_shows_tags_and_key_points(make_files):
    files = make_files({"d/a.ts": "x", "d/b.ts": "React"}).withColumn("tags", F.array(F.lit("directory/core"), F.lit("file/api"))).withColumn(
        "ai_summary", F.lit("Sum")).withColumn("key_points", F.array(F.lit("p1"), F.lit("p2")))
    lines = [r.line for r in toc.toc_by_directory(files, "markdown").orderBy("directory", "file_name").collect()]
    assert lines[0] == "<details open><summary>📁 d/ *(core)*</summary>\n"
    assert lines[1] == ("  - [a.ts](#d-a-ts) *(Source file | Tags: api)* \n    - Sum\n    <details><summary>Key Points</summary>\n\n"
                        "      - p1\n      - p2\n    </details>")
    text = [r.line for r in toc.toc_by_directory(files).orderBy("directory", "file_name").collect()]
    assert text[1] == "  a.ts (Server Component)\n    Purpose: Source file\n    Summary: Sum\n    Key Points:\n      • p1\n      • p2"
    assert "<li>p2</li>" in toc.toc_by_directory(files, "html").filter("file_name = 'b.ts'").first().line


def test_style_dispatch(make_files):
    files = make_files({"a.ts": "x"})
    assert sections.document_sections(files, "HTML").first().text.startswith("<div")
    assert sections.document_sections(files, "other").first().text.startswith("File:")
    assert sections.tree_sections(files, "html").first().text.startswith("<div class='file-header'")


def test_one_huge_file_is_spread_over_the_sink(spark, tmp_path):
    parts = spark.range(4000).selectExpr("'hot' as relative_path", "cast(id as int) as part_no", "cast(id as string) as text")
    state.write_report(parts, str(tmp_path / "r"), ["relative_path", "part_no"], partitions=4)
    assert _report(tmp_path / "r").split() == [str(i) for i in range(4000)]
    assert len([n for n in os.listdir(tmp_path / "r") if n.startswith("part-")]) == 4


def test_versions_ignore_unfinished_writes(spark, tmp_path):
    base = str(tmp_path / "v")
    assert versions.read_latest(spark, base, schema.STATE).count() == 0
    one = spark.createDataFrame([("a", "1")], schema.STATE)
    assert versions.write_version(one, base) == 0 and versions.write_version(one.union(one), base) == 1
    os.makedirs(f"{base}/version=2")
    assert versions.read_latest(spark, base, schema.STATE).count() == 2


def test_snapshot_store(spark, make_files, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"), keep=2)
    files = make_files({"a.ts": "x" * 20})
    for i in range(3):
        store.create(files, f"s{i}", datetime.datetime(2025, 1, 1 + i), f"run {i}", ["t"])
    assert sorted(r.snapshot_id for r in store.headers().collect()) == ["s1", "s2"]
    stats = snapshots.snapshot_stats(store.files("s2")).first()
    assert (stats.total_files, stats.total_size) == (1, 20)
    assert snapshots.language_breakdown(store.files("s2")).first().language == "typescript"
    assert store.update("s2", description="new") and not store.update("none", description="x")
    row = store.get("s2").first()
    assert row.description == "new" and row.tags == ["t"]
    assert store.delete("s1") and not store.delete("s1") and store.headers().count() == 1
    assert os.listdir(tmp_path / "s" / "files") == ["snapshot_id=s2"]
    store.create(files, "old", datetime.datetime(2024, 1, 1))
    store.create(files, "older", datetime.datetime(2023, 1, 1))  # not among the newest two
    assert sorted(os.listdir(tmp_path / "s" / "files")) == ["snapshot_id=old", "snapshot_id=s2"]


def test_named_snapshots(spark):
    rows = [(n, n, datetime.datetime(2025, 1, 1)) for n in ("b", "a")]
    stored = spark.createDataFrame(rows, schema.NAMED_SNAPSHOTS)
    saved = snapshots.save_named(stored, spark.createDataFrame([("a", "new", datetime.datetime(2025, 1, 2))], schema.NAMED_SNAPSHOTS))
    assert [r.name for r in snapshots.list_named(saved).collect()] == ["a", "b"]
    assert snapshots.load_named(saved, "a").first().content == "new" and snapshots.load_named(saved, "q").count() == 0
    assert snapshots.delete_named(saved, saved.filter("name = 'a'")).count() == 1


def test_tag_store(spark, tmp_path):
    base = str(tmp_path / "tags")
    _, _, settings = state.load_tags(spark, base)
    assert tuple(settings.first()) == (True, False)
    config = tmp_path / "tags.json"
    config.write_text(json.dumps({
        "tags": [{"id": "t", "name": "T", "scope": "both"}], "inheritance": {"enabled": True, "override": False},
        "appliedTags": {"src/a.ts": [{"id": "t", "name": "T", "scope": "both", "appliedTo": "src/a.ts", "appliedAt": "2025-01-16T00:00:00Z"}]}}))
    tags, applied = state.read_tag_config(spark, str(config))
    state.save_tags(tags, applied, base, enabled=False, override=True)
    tags, applied, settings = state.load_tags(spark, base)
    assert tags.first().tag_id == "t" and applied.first().applied_to == "src/a.ts" and tuple(settings.first()) == (False, True)


def test_shared_folder_is_the_configured_one(spark):
    assert session.new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
