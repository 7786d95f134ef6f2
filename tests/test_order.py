import random

from corpuscope.operators import order

PATHS = ["b/a", "a/b", "a", "B", "é", "a b", "a-b", "z"]


def test_by_path_is_binary_order(make_files):
    random.Random(1).shuffle(PATHS)
    got = [r.relative_path for r in order.by_path(make_files({p: "x" for p in PATHS}).repartition(4)).collect()]
    assert got == sorted(PATHS, key=lambda p: p.encode())


def test_user_order_first_then_the_rest_by_path(spark, make_files):
    ranks = spark.createDataFrame([("z", 1), ("a", 2), ("not there", 0)], "relative_path string, rank int")
    got = [r.relative_path for r in order.by_user_order(make_files({p: "x" for p in PATHS}).repartition(4), ranks).collect()]
    assert got == ["z", "a", *sorted(set(PATHS) - {"z", "a"}, key=lambda p: p.encode())]
