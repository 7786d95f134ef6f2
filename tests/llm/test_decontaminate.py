import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import decontaminate
from corpuscope.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wanted = {}
    for key, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            wanted.setdefault(tuple(own[i:i + size]), set()).add(key)
    out = []
    for key, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(own) - size + 1):
                if (named := wanted.get(tuple(own[i:i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= named
        out.append((str(key), len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


def run(docs, items, window=10):
    rows = decontaminate.hits(docs, items, window).collect()
    for r in rows:  # joined spans, in order
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in rows)


@pytest.mark.parametrize("window", [1, 2, 5, 10])
def test_random_texts(spark, window, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 16)
    draw = random.Random(window)
    text = lambda n, most: " ".join(draw.choice(["w", "W", "é"]) + str(draw.randrange(most)) for _ in range(n))
    items = [(i, text(draw.choice([1, 3, 9, 12, 30]), 400)) for i in range(25)] + [(3, text(15, 400))]
    docs = []
    for key in range(80):
        pieces = [text(draw.randrange(60), draw.choice([2, 400]))]
        for _ in range(draw.randrange(3)):
            own = draw.choice(items)[1].split()
            a = draw.randrange(len(own))
            pieces += [" - ".join(own[a:a + draw.randrange(1, 25)]), text(draw.randrange(8), 400)]
        docs.append((key, ", ".join(pieces)))
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
              spark.createDataFrame(items, "item_id long, text string"), window)
    assert got == brute(docs, items, window)
    assert any(row[2] for row in got)


def test_defined_cases(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    same = "very " * 30
    items = [(1, passage), (None, "q1 q2 q3"), (2, None), (3, "..."), (4, ""), (5, "One"), (6, same), (6, "other words here"), (7, passage)]
    long = " ".join(f"x{i}" for i in range(30_000)) + " " + passage + " " + " ".join(f"y{i}" for i in range(5_000))
    docs = [("a", passage), ("a", passage), ("a", "A different P0 text"), (None, None), (None, ""), ("b", " \n"), ("c", "q1-q2 Q3!"), ("d", "say one"),
            ("e", "very " * 45), ("f", long), ("g", " ".join(passage.split()[:9])), ("h", "Other  words\x00here"), (None, passage.upper())]
    frame = spark.createDataFrame([(*r, 1, 2, [3]) for r in docs], "doc_id string, text string, t1 int, spans int, items array<int>")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, words int")
    assert run(frame, bench) == brute(docs, items, 10)
    none = [(k, n, 0, []) for k, n, _, _ in brute(docs, items, 10)]
    assert run(frame, bench.limit(0)) == none and run(frame.limit(0), bench) == []
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) + str(r.text)[:9] for r in kept.collect()) == sorted(
        str(k) + str(t)[:9] for k, t in docs if not brute([(k, t)], items, 10)[0][2])


def test_one_text_holds_a_third_of_the_rows(spark):
    items = [(i, " ".join(f"common{j}" for j in range(12)) + f" own{i}") for i in range(60)]
    docs = [(i, items[0][1]) for i in range(200)] + [(200 + i, f"doc {i} {items[i % 60][1]} end") for i in range(400)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items, 10)


def test_query_is_native_and_reads_all(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
                   for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    frame = QUERIES["op13_decontamination"](spark, folder)
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())
    assert got == sorted((k, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
                         for k, n, hit, found in brute(docs, items, 10))
    assert frame.where(F.col("contaminated")).count() > 0
