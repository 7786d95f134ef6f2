import random
import re
from fractions import Fraction

import numpy as np
import pytest

from corpuscope import session
from corpuscope.llm import graph, jaccard
from corpuscope.llm.queries import QUERIES


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, n, t):
    sets = [grams(text, n) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * t.denominator >= max(len(a), len(b)) * t.numerator:
                both = len(a & b)
                if both * t.denominator >= (len(a) + len(b) - both) * t.numerator:
                    parent[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        rank = (key is None, key)
        low[root(i)] = min(low.get(root(i), rank), rank, key=lambda x: (x[0], x[1] or 0))
    return sorted((str(key), len(sets[i]), str(low[root(i)][1])) for i, (key, _) in enumerate(rows))


def found(df, n, t):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.linked(df, n, t).collect())


@pytest.mark.parametrize("n,t,edits", [(1, Fraction(4, 5), 4), (2, Fraction(9, 10), 2), (3, Fraction(1, 2), 6)])
def test_random_texts(spark, n, t, edits):
    draw = random.Random(n)
    rows = []
    for key in range(150):
        if rows and draw.random() < 0.7:
            words = draw.choice(rows)[1].split()
            for _ in range(draw.randrange(edits)):
                if words:
                    words[draw.randrange(len(words))] = str(draw.randrange(300))
            words = words[:len(words) - draw.randrange(3)]
        else:
            words = [str(draw.randrange(draw.choice([5, 300]))) for _ in range(draw.randrange(40))]
        rows.append((key, " ".join(words)))
    draw.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, t) == brute(rows, n, t)


def test_hot_groups(spark):
    """Many copies, many near copies, and a passage that most documents share."""
    draw = random.Random(9)
    base = [str(draw.randrange(10**6)) for _ in range(120)]
    passage = [str(draw.randrange(10**6)) for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(100)]
    rows += [(200 + i, " ".join([*base[:i % 100], f"edit{i}", *base[i % 100 + 1:]])) for i in range(120)]
    rows += [(400 + i, " ".join([*passage, *(str(draw.randrange(10**6)) for _ in range(30))])) for i in range(120)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(9, 10)) == brute(rows, 3, Fraction(9, 10))


def test_many_texts_near_one(spark):
    """Copies of one text with changes of their own, most of them too far from each other: the result is whole, and the pairs of
    groups that go on to be compared are far fewer than all."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for key in range(400):
        words = list(base)
        for at in draw.sample(range(150), draw.randrange(1, 9)):
            words[at] = f"v{draw.randrange(60)}"
        rows.append((key, " ".join(words)))
    df, made = spark.createDataFrame(rows, "doc_id long, text string"), {}

    def written(rows, label):
        made.setdefault(label, []).append(out := session.written(rows, label))
        return out

    out = jaccard._linked(df, 5, Fraction(4, 5), "text", "doc_id", written)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == brute(rows, 5, Fraction(4, 5))
    assert made["lists"][0].select("component").distinct().count() > 100
    assert made["probes"][0].count() < 8 * len(rows)


def test_parities_bound_the_difference():
    draw = np.random.default_rng(3)
    for _ in range(50):
        common, one, two = (draw.integers(0, 2**63, int(n), np.uint64) for n in draw.integers(0, 300, 3))
        grams = [np.concatenate([common, one]), np.concatenate([common, two])]
        a, b = jaccard.parities(np.cumsum([0, *map(len, grams)]), np.concatenate(grams)).view(np.uint64).reshape(2, jaccard.MARKS)
        assert int(np.bitwise_count(a ^ b).sum()) <= len(one) + len(two)


def test_defined_cases(spark):
    long = " ".join(str(i) for i in range(20_000))
    rows = [(5, None), (4, ""), (3, " \n"), (7, "A b"), (6, "a  B"), (8, "a b c"), (None, "x y z w"), (None, "x y z w"), (9, "x y z w"),
            (None, "solo text here now"), (10, long), (11, long + " end"), (12, "É b c"), (13, "é b c"), (14, "dup dup dup dup"), (14, "dup dup dup dup")]
    df = spark.createDataFrame([(a, b, 1, "z") for a, b in rows], "doc_id long, text string, size int, digest string")
    assert found(df, 3, Fraction(9, 10)) == brute(rows, 3, Fraction(9, 10))
    assert found(df.limit(0), 3, Fraction(9, 10)) == [] and found(df.limit(3), 3, Fraction(9, 10)) == brute(rows[:3], 3, Fraction(9, 10))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op6_jaccard_join"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == brute(docs, 3, Fraction(9, 10))


def test_parts_meet_for_every_linked_pair():
    draw = np.random.default_rng(1)
    for t in (Fraction(4, 5), Fraction(9, 10), Fraction(1, 2)):
        for size in [*range(1, 40), 300]:
            a = draw.integers(1, 1 << 62, size).astype(np.uint64)
            drop = int(size * (1 - t))
            b = a[drop:]
            c = np.concatenate([a[: size - drop], draw.integers(1, 1 << 62, int(len(a) / t) - size).astype(np.uint64)])
            for other in (b, c):
                both = len(np.intersect1d(a, other))
                if both * t.denominator >= (len(a) + len(other) - both) * t.numerator:
                    rows, signature = jaccard.parts(np.array([0, size, size + len(other)]), np.concatenate([a, other]), t)
                    assert set(signature[rows == 0]) & set(signature[rows == 1])


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(70)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
