import datetime
import random

from corpuscope import schema
from corpuscope.operators import changes, reuse, rollup
from corpuscope.sources import buckets, versions
from corpuscope.streaming import edits as st

EDITS = "path string, ts timestamp, content_hash string"
COLUMNS = "path string, ts timestamp, content_hash string, language string, size bigint"


def _at(minute):
    return datetime.datetime(2025, 1, 1, 0, minute)


def _stream(spark, folder, columns=COLUMNS):
    return spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)


def _write(spark, folder, rows, columns=COLUMNS):
    spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)


def test_language_stats_follow_edits(spark, tmp_path):
    folder, base = str(tmp_path / "log"), str(tmp_path / "stats")
    _write(spark, folder, [("a", _at(1), "1", "python", 10), ("b", _at(1), "1", "typescript", 5), ("a", _at(2), "2", "python", 12)])
    assert {tuple(r) for r in st.refresh_language_stats(_stream(spark, folder), base).collect()} == {
        ("python", 1, 12), ("typescript", 1, 5), (rollup.ALL_LANGUAGES, 2, 17)}
    _write(spark, folder, [("a", _at(3), "3", "typescript", 7), ("c", _at(3), "1", "go", 1)])
    _write(spark, folder, [("c", _at(2), "0", "rust", 100)])  # late: the newer edit stays
    assert {tuple(r) for r in st.refresh_language_stats(_stream(spark, folder), base).collect()} == {
        ("typescript", 2, 12), ("go", 1, 1), (rollup.ALL_LANGUAGES, 3, 13)}


def test_change_feed(spark, tmp_path):
    folder, base = str(tmp_path / "log"), str(tmp_path / "feed")
    _write(spark, folder, [("hot", _at(i), str(i), None, None) for i in range(50)] + [("a", _at(1), "x", None, None)])
    _write(spark, folder, [("hot", _at(51), "49", None, None), ("a", _at(2), "y", None, None), ("b", _at(2), "z", None, None)])
    st.write_change_feed(_stream(spark, folder), base)
    _write(spark, folder, [("a", _at(1), "late", None, None), ("b", _at(9), "w", None, None)])
    rows = st.write_change_feed(_stream(spark, folder), base).collect()
    assert sorted((r.path, r.change_type, r.old_hash, r.new_hash) for r in rows if r.path != "a" or r.change_type == "added") == sorted([
        ("hot", "added", None, "49"), ("a", "added", None, "x"), ("b", "added", None, "z"), ("b", "modified", "z", "w")])
    assert [(r.old_hash, r.new_hash) for r in rows if r.path == "a" and r.change_type == "modified"] == [("x", "y")]


def test_incremental_stream_equals_batch(spark, tmp_path):
    columns = "relative_path string, ts timestamp, content_hash string"
    folder, base = str(tmp_path / "log"), str(tmp_path / "run")
    old = [("a", "1"), ("b", "1"), ("gone", "1")]
    new = [("a", "2"), ("b", "1"), ("c", "1")]
    st.start_incremental(spark.createDataFrame(old, schema.STATE), base)
    _write(spark, folder, [(p, _at(1), h) for p, h in new] + [("a", _at(0), "1")], columns)
    st.incremental_run(_stream(spark, folder, columns), base, lambda files: files.select("relative_path", "content_hash"))
    got = st.incremental_results(spark, base, "relative_path string, content_hash string, change_type string")
    batch = changes.track_changes(spark.createDataFrame(old, schema.STATE), spark.createDataFrame(new, schema.STATE))
    assert {(r.relative_path, r.change_type) for r in got.collect()} == {
        (r.relative_path, r.change_type) for r in batch.collect() if r.change_type != "removed"}
    assert {tuple(r) for r in st.known_contents(base).read(spark).collect()} == {*new, ("gone", "1")}
    st.incremental_run(_stream(spark, folder, columns), base, lambda files: files)  # nothing new: nothing written
    assert versions.finished_versions(spark, f"{base}/results") == [0]


def test_a_small_batch_rewrites_only_its_buckets(spark, tmp_path):
    columns = "relative_path string, ts timestamp, content_hash string"
    folder, base = str(tmp_path / "log"), str(tmp_path / "run")
    old = [(f"dir/file{i}", str(i)) for i in range(2_000)]
    st.start_incremental(spark.createDataFrame(old, schema.STATE), base, bucket_rows=40)
    known = st.known_contents(base, 40)
    buckets = known.manifest(spark)
    assert len(buckets) >= 50 and max(b.n for b in buckets) <= 40 and sum(b.n for b in buckets) == 2_000
    edited = [(f"dir/file{i * 7}", _at(1), "new") for i in range(10)]
    _write(spark, folder, edited, columns)
    st.incremental_run(_stream(spark, folder, columns), base, lambda files: files.select("relative_path"), bucket_rows=40)
    after = known.manifest(spark)
    assert 1 <= sum(b.batch == 0 for b in after) <= 10
    assert set(p.name for p in (tmp_path / "run/state/data/batch=0").iterdir() if p.name.startswith("bucket=")) == {
        f"bucket={b.depth}-{b.prefix}" for b in after if b.batch == 0}
    want = dict(old) | {path: content for path, _, content in edited}
    assert {tuple(r) for r in known.read(spark).collect()} == set(want.items())
    # Folders that no kept manifest names go with the next batch; the table stays whole.
    _write(spark, folder, [(path, _at(2), "newer") for path, _, _ in edited] + [("another", _at(2), "1")], columns)
    st.incremental_run(_stream(spark, folder, columns), base, lambda files: files.select("relative_path"), bucket_rows=40)
    named = {(b.batch, f"bucket={b.depth}-{b.prefix}") for b in [*known.manifest(spark), *after] if b.n}
    there = {(int(f.name[6:]), p.name) for f in (tmp_path / "run/state/data").iterdir() for p in f.iterdir() if p.name.startswith("bucket=")}
    assert there == named
    assert len(versions.finished_versions(spark, f"{base}/state/manifest")) == 2
    want |= {path: "newer" for path, _, _ in edited} | {"another": "1"}
    assert {tuple(r) for r in known.read(spark).collect()} == set(want.items())


def test_a_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    table = buckets.Buckets(str(tmp_path), "k", "k string, v bigint", 10)
    table.upsert(spark.range(100).selectExpr("CAST(id AS STRING) AS k", "id AS v"), 0)
    fresh = spark.range(90, 130).selectExpr("CAST(id AS STRING) AS k", "-id AS v")
    for _ in range(2):
        table.upsert(fresh, 1)
        assert {(r.k, r.v) for r in table.read(spark).collect()} == {
            *((str(i), i) for i in range(90)), *((str(i), -i) for i in range(90, 130))}
    assert {(r.k, r.v) for r in table.read(spark, 1).collect()} == {(str(i), i) for i in range(100)}
    near = table.near(spark.createDataFrame([("5",)], "k string"))
    assert 1 <= near.count() < 40 and near.where("k = '5'").count() == 1
    assert table.near(spark.createDataFrame([], "k string")).count() == 0


def test_statistics_equal_the_batch_form(spark, tmp_path):
    folder, base = str(tmp_path / "log"), str(tmp_path / "stats")
    draw, edits = random.Random(3), []
    for batch in range(4):
        rows = []
        for _ in range(120):
            content = draw.choice(["1", "2", "3", None])
            rows.append((f"p{draw.randrange(60)}", _at(draw.randrange(12) + 3 * batch), content, draw.choice(["go", "rust", None]) if content else None,
                         draw.choice([1, 10, 100, None])))
        edits += rows
        _write(spark, folder, rows)
        got = {tuple(r) for r in st.refresh_language_stats(_stream(spark, folder), base, bucket_rows=8).collect()}
        live = reuse.latest_versions(spark.createDataFrame(edits, COLUMNS)).where("content_hash IS NOT NULL")
        assert got == {tuple(r) for r in rollup.language_stats(live).collect()}
    assert len(versions.finished_versions(spark, f"{base}/counts")) == 2


def test_feed_from_a_snapshot_in_any_order(spark, tmp_path):
    edits = [("a", _at(5), "x"), ("a", _at(5), "y"), ("a", _at(4), "z"), ("b", _at(3), None), ("b", _at(3), "old"), ("c", _at(2), None),
             ("d", _at(1), "late"), ("e", _at(6), None), ("e", _at(5), "gone"), ("f", _at(1), "same")]
    snapshot = spark.createDataFrame([("a", _at(1), "w"), ("c", _at(1), "c"), ("d", _at(2), "d"), ("e", _at(1), "e"), ("f", _at(0), "same")], EDITS)
    feeds = []
    for nth in range(3):
        folder, base = str(tmp_path / f"log{nth}"), str(tmp_path / f"feed{nth}")
        random.Random(nth).shuffle(edits)
        _write(spark, folder, edits, EDITS)
        st.write_change_feed(_stream(spark, folder, EDITS), base, snapshot)
        _write(spark, folder, [("e", _at(5), "late"), ("c", _at(7), "back"), ("b", _at(8), None)], EDITS)
        rows = st.write_change_feed(_stream(spark, folder, EDITS), base, snapshot).collect()
        feeds.append(sorted((r.path, r.ts, r.change_type, r.old_hash, r.new_hash) for r in rows))
    assert feeds[0] == feeds[1] == feeds[2] == sorted([
        ("a", _at(5), "modified", "w", "y"), ("b", _at(3), "added", None, "old"), ("c", _at(2), "removed", "c", None), ("e", _at(6), "removed", "e", None),
        ("c", _at(7), "added", None, "back"), ("b", _at(8), "removed", "old", None)])
