import math

import numpy as np
import pytest

from corpuscope.llm import whiten
from corpuscope.llm.queries import QUERIES


def brute(rows, most, scale=64, offset=10**6):
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = np.array([[math.floor(scale * c) + offset for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [(k, int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)))) for (k, _), row in zip(kept, x, strict=True)]
    y = ((n * x - s) / n).astype(float)
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, deviation, values, vectors, y, np.trace(v)


def close(got, rows, most):
    n, deviation, values, vectors, y, trace = brute(rows, most)
    kept = len({r.component for r in got})
    assert len(got) == n * kept and {r.n for r in got} <= {n}
    assert sorted({(r.vec_id, int(r.deviation)) for r in got}) == sorted(set(deviation))
    for c in range(kept):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        have = np.array([own[k].whitened for k, _ in deviation])
        want = y @ vectors[:, c] / math.sqrt(values[c])
        sign = np.sign(have @ want)
        assert np.allclose(have, sign * want, atol=1e-9)
        assert all(abs(r.explained - values[c] / trace) <= 1e-9 for r in own.values())
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    return kept


@pytest.mark.parametrize("size,most", [(1, 3), (7, 7), (40, 12)])
def test_random_vectors(spark, size, most):
    draw = np.random.default_rng(size)
    shape = draw.standard_normal((size, size)) * 3
    rows = [(i, (draw.standard_normal(size) @ shape).tolist()) for i in range(300)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), most).collect()
    assert close(got, rows, most) == min(size, most)


def test_defined_cases(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.standard_normal(5) * [5, 3, 2, 1, 0]).tolist()) for i in range(60)]
    extra = [(100, None), (101, [1.0, None, 2.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [2.0, 1.0]), (105, [])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows + extra], "vec_id long, embedding array<double>, component int, whitened string")
    got = whiten.whiten(frame, 32).collect()
    assert close(got, rows + extra, 4) == 4  # the last dimension does not vary
    for few in (frame.limit(0), frame.where("vec_id = 0"), frame.where("vec_id >= 100 AND vec_id < 104")):
        assert whiten.whiten(few).collect() == []
    twice = spark.createDataFrame([(None, [1.0, 2.0])] * 2 + [(7, [3.0, 1.0])] * 2, "vec_id int, embedding array<float>")
    out = whiten.whiten(twice).collect()
    assert len(out) == 4 and {r.vec_id for r in out} == {None, 7} and {abs(round(r.whitened, 9)) for r in out} == {1.0}
    with pytest.raises(Exception, match="beyond"):
        whiten.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id int, embedding array<double>")).collect()


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 10**11 % 7_777_777_777_777), float(-i * 10**10)]) for i in range(50)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    assert sorted({(r.vec_id, int(r.deviation)) for r in got}) == sorted(brute(rows, 2)[1])


def test_counts_and_slices():
    draw = np.random.default_rng(5)
    for size in (1, 2, 33, 70):
        a = draw.standard_normal((size, size + 3))
        v = a @ a.T
        values = np.linalg.eigvalsh(v)
        for shift in draw.uniform(values[0] - 1, values[-1] + 1, 20):
            assert whiten.count_above(*whiten.tridiagonal(v), shift) == (values > shift).sum()
        got, vectors = whiten.leading(v, 10)
        assert np.allclose(got, values[::-1][:10], rtol=1e-12)
        assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-9) and np.allclose(v @ vectors.T, vectors.T * got, atol=1e-10 * values[-1])


@pytest.mark.parametrize("values", [[3.0, 3.0, 3.0, 1.0], [5.0, 4.0, 4.0, 4.0, 0.0, 0.0], [1.0, 1.0 + 1e-9, 1.0 + 2e-9, 0.5], [0.0, 0.0], [2.0] * 6])
def test_clusters(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))[0]
    for v in (np.diag(values), turn @ np.diag(values) @ turn.T):
        v = (v + v.T) / 2
        got, vectors = whiten.leading(v, len(values))
        assert np.allclose(got, sorted(values, reverse=True), atol=1e-12)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-6) and np.allclose(v @ vectors.T, vectors.T * got, atol=1e-11)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    frame = QUERIES["op12_whitening"](spark, folder)
    assert frame.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                            ("explained", "double"), ("identity_error", "double")]
    assert close(frame.collect(), rows, 32) == 32
