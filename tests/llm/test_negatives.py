import math
import random
from fractions import Fraction

import numpy as np
import pytest

from corpuscope.llm import negatives
from corpuscope.llm.queries import QUERIES


def brute(rows, anchors, positives, k, low, scale=256):
    def ready(some):
        found = {}
        for key, vector, label in some:
            if key is not None and label is not None and vector is not None and all(c is not None and math.isfinite(c) for c in vector):
                v = [math.floor(scale * c) for c in vector]
                while v and v[-1] == 0:
                    v.pop()
                found[key] = min(found.get(key, (label, tuple(v))), (label, tuple(v)))
        return [(key, *row) for key, row in found.items()]

    every, out = ready(rows), set()
    for key, label, v in ready(anchors):
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), i, other) for i, other, w in every if i != key]
        same = sorted({(s, i) for s, i, other in scored if other == label})[:positives]
        differ = sorted({(s, i) for s, i, other in scored if other != label})
        for s, i in same:
            inside = [(t, j) for t, j in differ if -t <= -s and -t * low.denominator >= -s * low.numerator][:k]
            out |= {(key, i, rank, j, -s, -t) for rank, (t, j) in enumerate(inside, 1)}
    return sorted(out)


def run(spark, rows, anchors, positives=5, k=5, low=Fraction(4, 5)):
    kinds = "vec_id long, embedding array<double>, label int, score string, rank int"
    frames = [spark.createDataFrame([(*r, "x", 1) for r in some], kinds) for some in (rows, anchors)]
    return sorted(tuple(r) for r in negatives.mine(frames[0].repartition(3), frames[1], positives, k, low).collect())


@pytest.mark.parametrize("dims,labels,low", [(1, 2, Fraction(1, 2)), (12, 3, Fraction(4, 5)), (20, 40, Fraction(1, 3))])
def test_random_vectors(spark, dims, labels, low, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "ROWS", 60)
    draw = np.random.default_rng(dims)
    kinds = draw.standard_normal((8, dims))
    rows = [(i, (kinds[i % 8] * draw.choice([0, 1]) + draw.standard_normal(dims) * draw.choice([0.01, 0.5])).tolist(), int(draw.integers(labels))) for i in range(220)]
    got = run(spark, rows, rows[::9], 4, 3, low)
    assert got == brute(rows, rows[::9], 4, 3, low) and got


def test_copies_hold_most_rows(spark):
    draw = random.Random(4)
    hot = [draw.uniform(-1, 1) for _ in range(8)]
    rows = [(i, hot, i % 3) for i in range(300)] + [(300 + i, [x + draw.uniform(-0.2, 0.2) for x in hot], i % 3) for i in range(90)]
    anchors = rows[:6] + rows[300:306]
    assert run(spark, rows, anchors) == brute(rows, anchors, 5, 5, Fraction(4, 5))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.95, 0.0], 1), (4, [0.8, 0.3, 0.0], 1), (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 1),
            (8, [inf], 1), (None, [1.0, 0.0], 1), (9, [1.0, 0.0], None), (10, [], 0), (11, [0.0, 0.0], 1), (12, [-1.0, 0.0], 0), (1, [1.0, 0.0], 0),
            (3, [0.9, 0.0], 1), (13, [1.0, 0.0], 0), (14, [0.9, 0.1], 1), (15, [1.0] * 500, 1), (16, [0.2] * 500, 0)]
    assert run(spark, rows, rows) == brute(rows, rows, 5, 5, Fraction(4, 5))
    for some, asked in (([], rows[:2]), (rows[11:13], rows[10:13])):
        assert run(spark, some, asked) == brute(some, asked, 5, 5, Fraction(4, 5))


def test_threshold_join_saves_products():
    draw = np.random.default_rng(2)
    anchors, rows = (np.floor(256 * (x / np.linalg.norm(x, axis=1, keepdims=True))) for x in (draw.standard_normal((40, 64)), draw.standard_normal((900, 64))))
    scores = anchors @ rows.T
    full = scores.size * 64
    before = 0
    for share in (0.9, 0.6, 0.45, 0.1, 0.0, -1.0):
        least = np.floor(share * 256.0**2 * draw.uniform(0.95, 1.05, 40))
        a, b, score, work = negatives.threshold_join(anchors, rows, least)
        want = np.argwhere(scores >= least[:, None])
        order = np.lexsort((b, a))
        assert (np.stack([a, b], 1)[order] == want).all() and (score == scores[a, b]).all()
        assert before <= work <= full  # lower thresholds index more
        before = work
        if share >= 0.6:
            assert work < 0.6 * full


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    anchors = [r for r in rows if r[0] % 100 == 0]
    frame = QUERIES["op11_hard_negatives"](spark, folder)
    assert frame.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
                            ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in frame.collect()) == brute(rows, anchors, 5, 5, Fraction(4, 5))
