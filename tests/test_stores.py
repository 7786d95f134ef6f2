import datetime
import os

from pyspark.sql import Observation, functions as F

from corpuscope.operators import snapshots
from corpuscope.plans import aggregate
from corpuscope.sources import files as fl
from corpuscope.sources import state


def test_report_parts_are_rendered_once_and_files_follow_their_bytes(spark, tmp_path):
    rendered = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def render(number):
        rendered.add(1)
        return f"{number:05d}" + "é" * 45  # 95 bytes and a line feed

    parts = spark.range(1000).select(
        F.lit("hot").alias("relative_path"), F.col("id").alias("part_no"), render("id").alias("body"))
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    n = state.write_report(parts, str(tmp_path / "r"), ["relative_path", "part_no"], text="body", file_bytes=24_000)
    assert (rendered.value, n) == (1000, 4)
    names = sorted(x for x in os.listdir(tmp_path / "r") if x.startswith("part-"))
    lines = "".join(open(tmp_path / "r" / x).read() for x in names).splitlines()
    assert len(names) == 4 and [line[:5] for line in lines] == [f"{i:05d}" for i in range(1000)]
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before


def test_an_empty_report_and_null_parts(spark, tmp_path):
    parts = spark.createDataFrame([("a", 0, None), ("a", 1, "x")], "relative_path string, part_no int, text string")
    assert state.write_report(parts.limit(0), str(tmp_path / "e"), ["relative_path", "part_no"]) == 1
    assert state.write_report(parts, str(tmp_path / "n"), ["relative_path", "part_no"]) == 1
    assert "x\n" in "".join(open(tmp_path / "n" / x).read() for x in os.listdir(tmp_path / "n") if x.startswith("part-"))


def test_a_smaller_keep_frees_all_that_fall_out(spark, make_files, tmp_path):
    files = make_files({"a.ts": "x"})
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"), keep=5)
    for i in range(5):
        store.create(files, f"s{i}", datetime.datetime(2025, 1, 1 + i))
    snapshots.SnapshotStore(spark, str(tmp_path / "s"), keep=2).create(files, "s5", datetime.datetime(2025, 1, 6))
    assert sorted(os.listdir(tmp_path / "s" / "files")) == ["snapshot_id=s4", "snapshot_id=s5"]


def test_orphans_are_swept_when_nothing_writes_them(spark, make_files, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "PAGE", 2)  # several pages
    files = make_files({"a.ts": "x"})
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"))
    assert store.sweep(0) == 0  # no store yet
    store.create(files, "named", datetime.datetime(2025, 1, 1))
    for i in range(5):
        files.write.parquet(f"{tmp_path}/s/files/snapshot_id=lost{i}")
    os.makedirs(tmp_path / "s" / "files" / "snapshot_id=started" / "_temporary")
    (tmp_path / "s" / "files" / "other").mkdir()
    assert {r.snapshot_id for r in store.orphans().collect()} == {*(f"lost{i}" for i in range(5)), "started"}
    assert store.sweep() == 0  # written to a moment ago: perhaps by a run without a header yet
    old = datetime.datetime(2020, 1, 1).timestamp()
    for folder, _, names in os.walk(tmp_path / "s" / "files" / "snapshot_id=lost3"):
        for path in [folder, *(os.path.join(folder, n) for n in names)]:
            os.utime(path, (old, old))
    assert store.sweep() == 1 and store.sweep(0) == 5
    assert sorted(os.listdir(tmp_path / "s" / "files")) == ["other", "snapshot_id=named"]
    assert store.files("named").count() == 1


def test_a_scan_keeps_a_reason_for_every_listed_file(spark, tmp_path):
    for name, content in {"a.txt": b"text", "b.txt": b"\xff\xfe", "c.txt": b"x" * 50, "d.txt": b"\xff" * 50, "e.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    counts = Observation("scan")
    rows = aggregate.tree_scan(spark, str(tmp_path), max_bytes=10, observation=counts)
    assert {r.relative_path: (r.content, r.reject_reason) for r in rows.collect()} == {
        "a.txt": ("text", None), "b.txt": (None, fl.UNDECODABLE), "c.txt": (None, fl.TOO_LARGE),
        "d.txt": (None, fl.TOO_LARGE), "e.txt": ("", None)}
    assert counts.get == {"listed": 5, "kept": 2, "too_large": 2, "undecodable": 1}
    assert {r.relative_path for r in fl.rejected(rows).collect()} == {"b.txt", "c.txt", "d.txt"}
    assert "bytes" not in rows.columns and "reject_reason" not in fl.kept_texts(rows).columns
    assert "MapInPandas" not in rows._jdf.queryExecution().toString()  # a table: no file is opened again


def test_a_large_file_is_never_opened(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "gone.txt").write_text("y" * 100)
    from corpuscope.sources import tree
    listed = tree.list_tree(spark, str(tmp_path / "in"))
    listed.count()
    (tmp_path / "in" / "gone.txt").unlink()  # opening it would fail now
    row = fl.tagged(tree.read_bytes(listed, str(tmp_path / "in"), 10), 10).first()
    assert row.reject_reason == fl.TOO_LARGE and row.bytes is None and row.size == 100
