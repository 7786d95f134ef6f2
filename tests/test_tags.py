import random

from corpuscope.operators import ranking, tags

TAGS = [("f", "file"), ("d", "directory"), ("b", "both"), ("common", "both")]


def _names(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, created_order bigint")


def _ids(rows):
    return [r.tag_id for r in rows.orderBy("created_order").collect()]


def test_duplicate_names(spark):
    assert _ids(tags.new_tag_ids(_names(spark, ["Test", "Test", "Other tag!", "test"]))) == ["test", "test-1", "other-tag-", "test-2"]


def test_ids_stay_unique_across_slugs_and_existing_ids(spark):
    existing = spark.createDataFrame([("test",), ("test-2",)], "tag_id string")
    names = ["Test", "test 1", "Test", "Test 3", "TEST", "test 1", "new"]
    ids = _ids(tags.new_tag_ids(_names(spark, names), existing))
    assert len(set(ids) | {"test", "test-2"}) == len(names) + 2
    assert ids[1] == "test-1" and ids[3] == "test-3" and ids[6] == "new"
    assert [ids[0], ids[2], ids[4]] == ["test-4", "test-5", "test-6"]


def test_ranks_in_a_hot_group(spark):
    random.seed(1)
    rows = [("hot" if random.random() < 0.7 else f"g{random.randrange(20)}", i * i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o bigint")
    wanted, count = {}, {}
    for group, order in rows:
        count[group] = count.get(group, 0) + 1
        wanted[(group, order)] = count[group]
    got = {(r.g, r.o): r.position for r in ranking.number_rows(df, "g", "o", buckets=16).collect()}
    assert got == wanted


def test_scope(spark):
    known = spark.createDataFrame(TAGS, "tag_id string, scope string")
    wanted = [(t, p, k) for t in ("f", "d", "b", "unknown") for p, k in (("x.ts", "file"), ("dir", "directory"))]
    requests = spark.createDataFrame(wanted, "tag_id string, applied_to string, kind string")
    got = {tuple(r) for r in tags.apply_tags(known, requests).collect()}
    assert got == {("f", "x.ts"), ("d", "dir"), ("b", "x.ts"), ("b", "dir")}


def test_inheritance(spark):
    applied = spark.createDataFrame(
        [("parent", "parent-dir"), ("child", "parent-dir/child.ts"), ("common", "parent-dir"), ("common", "parent-dir/child.ts"),
         ("root", "."), ("deep", "parent-dir/a"), ("parent", "parent-dir/a")], "tag_id string, applied_to string")
    targets = spark.createDataFrame([("parent-dir/child.ts",), ("parent-dir/a/b/c.ts",), ("top.ts",)], "relative_path string")

    def held(path, **options):
        rows = tags.effective_tags(targets, applied, **options).filter(f"relative_path = '{path}'").collect()
        return sorted((r.distance, r.tag_id) for r in rows)

    assert held("parent-dir/child.ts") == [(0, "child"), (0, "common"), (1, "common"), (1, "parent")]
    assert held("parent-dir/child.ts", override=True) == [(0, "child"), (0, "common"), (1, "parent")]
    assert held("parent-dir/child.ts", enabled=False) == [(0, "child"), (0, "common")]
    assert held("parent-dir/a/b/c.ts") == [(2, "deep"), (2, "parent"), (3, "common"), (3, "parent")]
    assert held("top.ts") == []


def test_removal(spark):
    applied = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "tag_id string, applied_to string")
    gone = spark.createDataFrame([("a", "x"), ("c", "y")], "tag_id string, applied_to string")
    assert {tuple(r) for r in tags.remove_tags(applied, gone).collect()} == {("a", "y"), ("b", "x")}
