import hashlib
import random
import re

import numpy as np
import pytest

from corpuscope.llm import substring, windows
from corpuscope.llm.queries import QUERIES


def brute(rows, window):
    """(id, text) -> (words, removed positions); ids may be None."""
    seen = {}
    for key, text in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(parts) - window + 1):
            w = tuple(parts[i:i + window])
            rank = float("inf") if key is None else key
            seen[w] = min(seen.get(w, rank), rank)
    out = []
    for key, text in rows:
        parts = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(parts) - window + 1):
            if seen[tuple(parts[i:i + window])] < (float("inf") if key is None else key):
                gone.update(range(i, i + window))
        kept = " ".join(p for i, p in enumerate(parts) if i not in gone)
        out.append((str(key), len(parts), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df, window):
    rows = substring.remove(df, window).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(
        (r.text if r.n_removed else " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("window,alphabet", [(2, 3), (5, 2), (7, 4), (8, 30)])
def test_random_texts(spark, window, alphabet):
    draw = random.Random(window)
    rows = []
    for key in range(60):
        parts = [str(draw.randrange(alphabet)) for _ in range(draw.randrange(40))]
        if rows and draw.random() < 0.5:
            other = draw.choice(rows)[1].split()
            at = draw.randrange(len(other) + 1)
            parts = parts[:5] + other[at:at + draw.randrange(30)] + parts[5:]
        rows.append((key, " \n".join(parts)))
    draw.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window) == brute(rows, window)


def test_defined_cases(spark):
    long = " ".join(str(i % 977) for i in range(30_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x a b\tc d y"), (3, None), (None, "a b c d"), (None, "n m o p"), (None, "n m o p"),
            (4, ""), (5, "a b"), (6, long), (7, long + " z"), (8, "é a b ü ö"), (9, "é a b ü ö")]
    df = spark.createDataFrame([(a, b, "k", 7) for a, b in rows], "doc_id long, text string, anchor string, n_words int")
    assert found(df, 4) == brute(rows, 4)
    result = substring.remove(df, 4)
    assert set(result.columns) == {"doc_id", "text", "anchor", "n_words", "n_removed", "spans"}
    kept = {(r.doc_id, r.text, r.anchor) for r in result.collect()}
    assert (5, "a b", "k") in kept and (3, None, "k") in kept and (2, "x y", "k") in kept
    assert substring.remove(df.limit(0), 4).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op7_substring_dedup"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute(texts, 50)
    assert any(r.n_removed for r in rows)


def test_minima_and_union():
    values = np.array([5, 1, 1, 4, 0, 0, 9], np.uint64)
    for width in range(1, 7):
        assert windows.leftmost_minima(values, width).tolist() == [i + int(np.argmin(values[i:i + width])) for i in range(8 - width)]
    starts, ends = windows.union(np.array([9, 1, 3, 6]), np.array([12, 4, 5, 8]))
    assert list(zip(starts.tolist(), ends.tolist())) == [(1, 5), (6, 8), (9, 12)]
