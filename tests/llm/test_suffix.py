import hashlib
import random

import numpy as np
import pytest

from corpuscope.llm import suffix


def brute(rows, window, keep):
    """Rows of (id, text); for "first", rows that repeat id and text are one place."""
    rank = {r: i for i, r in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))}
    places = {}
    for at, (key, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            places.setdefault(data[i:i + window], set()).add((rank[key, text], i, at if keep == "none" else 0))
    out = []
    for at, (key, text) in enumerate(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - window + 1):
            seen = places[data[i:i + window]]
            own = (rank[key, text], i, at if keep == "none" else 0)
            if (len(seen) > 1) if keep == "none" else (min(seen) < own):
                gone[i + 1:i + window + 1] = True
        mask = gone[1:-1]
        kept = bytes(b for b, g in zip(data, mask) if not g)
        out.append((str(key), len(data), int(mask.sum()), int(((~gone[:-1]) & gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df, window, keep):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in suffix.remove(df, window, keep).collect())


def texts(draw, count, alphabet, length):
    rows = []
    for key in range(count):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(length)))
        if rows and draw.random() < 0.6:
            other = draw.choice(rows)[1]
            at = draw.randrange(len(other) + 1)
            text = text[: len(text) // 2] + other[at:at + draw.randrange(length)] + text[len(text) // 2:]
        rows.append((key, text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("group,window,alphabet", [(1 << 20, 8, "ab"), (60, 8, "abc"), (200, 16, "é漢xyz"), (30, 13, "ab")])
def test_random_texts(spark, monkeypatch, keep, group, window, alphabet):
    monkeypatch.setattr(suffix, "GROUP_BYTES", group)
    rows = texts(random.Random(group + window), 50, alphabet, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, window, keep) == brute(rows, window, keep)


@pytest.mark.parametrize("keep", ["first", "none"])
def test_defined_cases(spark, keep):
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 50), (5, long), (None, "x" + long[:500]), (6, long[20_000:] + "!"),
            (7, "twice the same row"), (7, "twice the same row"), (None, "null ids, the same"), (8, "null ids, the same")]
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, kept string, start int")
    assert found(df, 12, keep) == brute(rows, 12, keep)
    assert found(df.limit(0), 12, keep) == []


def test_factors_against_definition():
    draw = np.random.default_rng(5)
    for size in (1, 2, 30, 200):
        data = draw.integers(0, 3, size).astype(np.uint8)
        levels = suffix.ranks(data, 10)
        order = np.array(sorted(range(size), key=lambda i: (data[i:i + 10].tobytes(), i)))
        assert (np.lexsort((np.arange(size), levels[-1][1])) == order).all()
        shared = np.append(0, suffix.common_prefix(levels, order[:-1], order[1:]))
        got = suffix.previous_factors(np.arange(size), order, shared)
        for i in range(size):
            best = 0
            for j in range(i):
                n = 0
                while n < 10 and i + n < size and data[i + n] == data[j + n]:
                    n += 1
                best = max(best, n)
            assert got[i] == best


def test_query(spark):
    from corpuscope.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op2_suffix_dedup"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute(docs, 400, "none")
    assert any(r.n_removed for r in rows)


@pytest.mark.parametrize("limit", [1, 7, 64])
def test_cut_rows_give_the_same(spark, monkeypatch, limit):
    """Portions of any size: long rows are cut, and nothing is lost at the cuts."""
    whole = suffix.w.bounded_stretches
    monkeypatch.setattr(suffix.w, "bounded_stretches", lambda *a: whole(*a, limit=limit))
    draw = np.random.default_rng(limit)
    offsets = np.array([0, 5, 5, 60, 200])
    symbols = draw.integers(0, 1 << 60, 200).astype(np.uint64)
    covered = set()
    for s in suffix.w.bounded_stretches(lambda a, b: symbols[a:b], offsets, 9, 3):
        for row, start, count in zip(s["row"], s["start"], s["count"]):
            new = {(int(row), int(start) + i) for i in range(count)}
            assert not new & covered
            covered |= new
    assert covered == {(row, i) for row, size in enumerate(np.diff(offsets)) for i in range(size - 8)}
