import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import topk
from corpuscope.llm.queries import QUERIES


def brute(rows, wanted, k, scale=256):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    good = {(i, tuple(w)) for i, v in rows if i is not None and (w := whole(v)) is not None}
    out = []
    for i, q in good:
        if wanted(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(df, wanted, k):
    return sorted(tuple(r) for r in topk.search(df, df.where(wanted), k).collect())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op5_topk_search"](spark, folder).collect()) == brute(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("k,width,block", [(1, 1, 3), (3, 5, 7), (5, 8, 1000)])
def test_random_vectors(spark, monkeypatch, k, width, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block * 2)
    draw = random.Random(k)
    rows = [(i, [draw.randrange(-3, 4) / 2 for _ in range(width)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, "vec_id % 10 = 0", k) == brute(rows, lambda i: i % 10 == 0, k)


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None), (6, [float("nan"), 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, [-1.0, -1.0]), (10, []), (None, [9.0, 9.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, score int, rank int")
    for k in (1, 2, 4, 20):
        assert found(df, "vec_id % 5 = 0", k) == brute(rows, lambda i: i % 5 == 0, k)
    assert found(df.limit(0), "true", 3) == [] and found(df, "false", 3) == []
    assert found(df.where("vec_id = 9"), "true", 3) == []


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [i / 50, 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(df, "vec_id % 50 = 0", 5) == brute([(i, [x for x in v]) for i, v in df.collect()], lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("size", [100, 2**13, 2.9e6])
def test_sizes_of_numbers(spark, monkeypatch, size):
    """Scores that are exact in floats, in doubles and in integers only, of vectors of several lengths."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 9)
    draw = random.Random(int(size))
    rows = [(i, [draw.uniform(-1, 1) * draw.choice([0, 0.1, 1, size]) for _ in range(draw.randrange(1, 4))] + [0.0] * draw.randrange(2)) for i in range(90)]
    df = spark.createDataFrame([*rows, *((i + 90, v) for i, v in rows[:30])], "vec_id long, embedding array<double>").repartition(3)
    assert found(df, "vec_id % 3 = 0", 4) == brute([tuple(r) for r in df.collect()], lambda i: i % 3 == 0, 4)


def test_bytes_and_back():
    rows = [[1.0, -2.0, 0.0], [], [0.0, 0.0], [float("nan")], [300.5, 1.0], [None, 1.0], [-0.001], [2.0**40, 0.0, -1.0], [127.0, -128.0]]
    places, made = topk._as_bytes(pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1), 1)
    assert places.tolist() == [0, 1, 2, 4, 6, 7, 8] and made[1].as_py() == made[2].as_py()
    wanted = [[1, -2, 0], [0, 0, 0], [0, 0, 0], [300, 1, 0], [-1, 0, 0], [2**40, 0, -1], [127, -128, 0]]
    assert topk._matrix(made).tolist() == wanted and topk._matrix(made.slice(3, 1)).tolist() == [[300, 1]]
    assert [topk._matrix(made.slice(i, 1)).itemsize for i in range(7)] == [1, 1, 1, 2, 1, 8, 2]


def test_blocks_do_not_pass_the_driver(spark, monkeypatch):
    """Below the function that meets blocks in pairs nothing is broadcast, although the blocks' files are small."""
    plans, written = [], topk.session.written
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 3)
    monkeypatch.setattr(topk.session, "written", lambda df, label: plans.append(plan(df)) or written(df, label))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString().splitlines()

    df = spark.createDataFrame([(i, [i / 8, i % 7 / 8]) for i in range(60)], "vec_id long, embedding array<double>")
    plans.append(plan(topk.search(df, df.where("vec_id % 3 = 0"))))
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    meet = [(p, i) for p in plans for i, line in enumerate(p) if "MapInArrow" in line and "q_no" in line and "c_no" in line]
    assert len(meet) == 2
    for p, i in meet:
        below = list(itertools.takewhile(lambda line: depth(line) > depth(p[i]), p[i + 1:]))
        assert below and not any("Broadcast" in line for line in below)
