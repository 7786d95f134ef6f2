from pyspark.sql import functions as F

from corpuscope.operators import changes, filters, reuse
from corpuscope.sources import state


def _kinds(rows):
    return {r.relative_path: r.change_type for r in rows.collect()}


def test_three_runs(spark, make_files, tmp_path):
    base = str(tmp_path / "state")
    runs = [{"test_file.py": "initial", "keep": "k"}, {"test_file.py": "updated", "keep": "k"}, {"keep": "k"}]
    seen = []
    for contents in runs:
        files = make_files(contents)
        seen.append(_kinds(changes.track_changes(state.load_state(spark, base), files)))
        state.save_state(files, base)
    assert seen == [{"test_file.py": "added", "keep": "added"}, {"test_file.py": "modified"}, {"test_file.py": "removed"}]


def test_incremental_run_sees_only_new_content(make_files):
    before, now = make_files({"file1.py": "v1", "file2.py": "v1"}), make_files({"file1.py": "v2", "file2.py": "v1", "file3.py": "v1"})
    assert sorted(r.relative_path for r in filters.changed_since(now, before).collect()) == ["file1.py", "file3.py"]


def test_counts_have_all_types_and_add_up(make_files):
    old, new = make_files({"a": "1", "b": "1", "c": "1"}), make_files({"a": "1", "b": "2", "d": "1", "e": "1"})
    counts = {r.change_type: r.n for r in changes.change_counts(changes.classify(old, new)).collect()}
    assert counts == {"added": 2, "modified": 1, "removed": 1, "unchanged": 1}
    assert counts["added"] + counts["modified"] + counts["unchanged"] == new.count()
    assert {r[0] for r in changes.added_paths(old, new).collect()} == {"d", "e"}
    assert {r[0] for r in changes.removed_paths(old, new).collect()} == {"c"}
    assert {r[0] for r in changes.kept_paths(old, new).collect()} == {"a", "b"}


def test_report(make_files):
    old, new = make_files({"a": "1", "b": "1"}), make_files({"b": "2", "d": "1", "c": "1"})
    order = ["section_no", "row_no", "relative_path"]
    lines = [r.line for r in changes.change_report(changes.track_changes(old, new)).orderBy(*order).collect()]
    assert lines == ["### Added Files", "", "- c (added)", "- d (added)", "", "### Modified Files", "", "- b (modified)", "",
                     "### Removed Files", "", "- a (removed)", ""]
    html = [r.line for r in changes.change_report(changes.track_changes(old, old.limit(1)), "html").orderBy(*order).collect()]
    assert html == ['<div class="changes-section">', "<h3>Removed Files</h3>", "<ul>", "<li>b (removed)</li>", "</ul>", "</div>"]


def _snapshot(spark, rows):
    return spark.createDataFrame(rows, "relative_path string, content string, frameworks array<string>, references array<string>")


def test_snapshot_comparison(spark):
    old = _snapshot(spark, [("unchanged", "a  b\n", ["x"], []), ("modified", "old", [], []), ("removed", "r", None, None),
                            ("analysis", "same", ["x"], ["r"]), ("gained", "same", None, None), ("none", "same", None, None)])
    new = _snapshot(spark, [("unchanged", "a b", ["x"], []), ("modified", "new", [], []), ("added", "n", None, None),
                            ("analysis", "same", ["x"], ["q"]), ("gained", "same", [], []), ("none", "same", None, None)])
    rows = {r.relative_path: tuple(r)[1:] for r in changes.compare_snapshots(old, new).collect()}
    assert rows == {
        "unchanged": ("unchanged", False, False), "modified": ("modified", True, False), "removed": ("removed", False, False),
        "added": ("added", False, False), "analysis": ("modified", False, True), "gained": ("modified", False, True),
        "none": ("unchanged", False, False)}
    assert changes.compare_snapshots(old, new, ignore_whitespace=False).filter("content_changed").count() == 2


def test_line_diff_of_unequal_lengths(spark):
    old = spark.createDataFrame([("a", "1\n2\n3"), ("b", "x"), ("c", "same \n"), ("d", "L")], "relative_path string, content string")
    new = spark.createDataFrame([("a", "1\nTwo"), ("b", "x\ny\nz"), ("c", " same\n\n"), ("d", "l")], "relative_path string, content string")
    diff = {r.relative_path: r.diff for r in changes.line_diff(old, new).collect()}
    assert diff == {"a": "- 2\n+ Two\n- 3", "b": "+ y\n+ z", "d": "- L\n+ l"}
    assert {r[0] for r in changes.line_diff(old, new, ignore_case=True).collect()} == {"a", "b"}


def test_reuse_analyses_each_new_content_once(spark, make_files):
    files = make_files({"a": "1", "b": "1", "c": "2", "d": "3", "e": "3"})
    stored = files.filter("relative_path = 'c'").select("content_hash", F.lit(-1).alias("score"))
    seen = []

    def analyse(todo):
        seen.extend(sorted(r.relative_path for r in todo.collect()))
        return todo.select("content_hash", F.length("content").alias("score"))

    analysis, store = reuse.reuse_analysis(files, stored, analyse)
    assert seen == ["a", "d"] and store.count() == 3
    assert {r.relative_path: r.score for r in analysis.collect()} == {"a": 1, "b": 1, "c": -1, "d": 1, "e": 1}
