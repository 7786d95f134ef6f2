from pyspark.sql import functions as F

from corpuscope.operators import ranking


def test_positions_equal_a_window_for_hot_null_and_small_groups(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 3001).alias("o"))
    groups = {}
    for row in rows.collect():
        groups.setdefault(row.g, []).append(row.o)
    wanted = {(g, o): i for g, values in groups.items() for i, o in enumerate(sorted(values), 1)}
    for ranges in (None, 1, 7):
        found = ranking.number_rows(rows, "g", "o", ranges).collect()
        assert len(found) == 3000 and {(r.g, r.o): r.position for r in found} == wanted


def test_ties_and_no_rows(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "b"), ("b", None)], "g string, o string")
    found = ranking.number_rows(rows, "g", "o", 3).collect()
    assert sorted((r.g, r.position) for r in found) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert [r.position for r in found if r.o == "b"] == [1]
    assert ranking.number_rows(rows.limit(0), "g", "o").count() == 0
