import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscope.llm import simhash
from corpuscope.llm.queries import QUERIES


def hashes(spark, pairs):
    df = spark.createDataFrame(sorted(pairs, key=str), "a string, b string")
    rows = df.select("a", "b", *[F.xxhash64(F.lit(s), "a", "b").alias(f"h{s}") for s in range(simhash.HALVES)]).collect()
    return {(r.a, r.b): [r[f"h{s}"] for s in range(simhash.HALVES)] for r in rows}


def terms_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return list(zip(words, [*words[1:], None]))


def brute(text, table):
    votes = [0] * (64 * simhash.HALVES)
    for a, b in terms_of(text):
        weight = min(len(a) + len(b or ""), simhash.MAX_WEIGHT)
        for half, h in enumerate(table[a, b]):
            for bit in range(64):
                votes[64 * half + bit] += weight if h >> bit & 1 else -weight
    return "".join(f"{sum(1 << bit for bit in range(64) if votes[64 * half + bit] > 0):016x}" for half in range(simhash.HALVES))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, folder).collect()}
    assert len(rows) == len(docs)
    edits = {}
    for (key, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        edits[key] = text[:len(text) - cut] + after[:cut]
    table = hashes(spark, {t for _, x in docs for t in terms_of(x)} | {t for x in edits.values() for t in terms_of(x)})
    prints = {k: brute(t, table) for k, t in docs}
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for (key, text), (after, _) in zip(docs, docs[1:] + docs[:1]):
        r, e = rows[key], brute(edits[key], table)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edits[key].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[key], e)
        assert (r.near_edited, r.near_next) == pytest.approx((near(prints[key], e), near(prints[key], prints[after])))


def test_one_term_all_over(spark):
    texts = [" ".join([f"term{n}longer"] * 20_000) for n in range(4)]
    rows = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    table = hashes(spark, {t for text in texts for t in set(terms_of(text))})
    assert {r.doc_id: r.fingerprint for r in rows} == {k: brute(t, table) for k, t in enumerate(texts)}


def test_terms_are_made_once(spark):
    """Texts on both sides of the longest single run, and no condition that has to make the terms to decide."""
    texts = [" ".join("abcdefg"[i % 7] for i in range(simhash.RUN + more)) for more in (-1, 0, 1)]
    texts += ["x" * size for size in (2 * simhash.RUN - 1, 2 * simhash.RUN, 5 * simhash.RUN)]
    prints = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    table = hashes(spark, {t for text in texts for t in terms_of(text)})
    assert {r.doc_id: r.fingerprint for r in prints.collect()} == {k: brute(t, table) for k, t in enumerate(texts)}
    plan = prints._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if re.match(r"[\s:+-]*Filter\b", x) and "zip_with" in x]


def test_defined_cases(spark, monkeypatch):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one", 3), (3, "one", 3), (None, "x y z", 4), (5, long, 5)],
                               "doc_id long, text string, bits int")
    rows = simhash.fingerprints(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.fingerprint)
    assert len(rows) == 6 and by[1] == by[2] == ["0" * 32] and len(set(by[3])) == 1 and len(by[3]) == 2
    assert by[5] == [brute(long, hashes(spark, set(terms_of(long))))]
    assert simhash.fingerprints(df.limit(0)).collect() == [] and simhash.edited(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [3, 50])
def test_next_row(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", size)
    draw = random.Random(size)
    ids = [draw.choice([None, *range(60), 10**15, -7]) for _ in range(80)]
    rows = [(i, f"t{n:02}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.text): r.after for r in simhash.with_next(df, ["doc_id", "text"], {"text": "after"}).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == {row: after[1] for row, after in zip(order, order[1:] + order[:1])}


def test_all_near_pairs(spark):
    draw = random.Random(3)
    seeds = [draw.getrandbits(128) for _ in range(30)]
    values = seeds + [x ^ sum(1 << b for b in draw.sample(range(128), draw.randrange(1, 7))) for x in seeds for _ in range(6)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(f"{x:032x}", [signed(x >> 64), signed(x & (1 << 64) - 1)]) for x in values + values[:5]]
    df = spark.createDataFrame(rows, "fingerprint string, bits array<bigint>")
    wanted = {(f"{min(a, b):032x}", f"{max(a, b):032x}", (a ^ b).bit_count()) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in simhash.near_pairs(df, 3).collect()} == wanted and wanted
    assert simhash.near_pairs(df.limit(0), 3).collect() == []


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
