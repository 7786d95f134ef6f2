import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import sharding
from corpuscope.llm.queries import QUERIES


def check_slots(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards))
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_sharding"](spark, folder).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
        (k, len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    check_slots(rows, 24)


@pytest.mark.parametrize("n,shards", [(0, 5), (3, 5), (1000, 7)])
def test_odd_rows(spark, monkeypatch, n, shards):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 30)
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "é").alias("text"),
                               F.lit("x").alias("shard"), F.lit(1).alias("size")).repartition(3)
    rows = sharding.assign(df, shards).collect()
    assert len(rows) == n and {r.size for r in rows} <= {8, 10}
    check_slots(rows, shards)


def test_shuffle_is_uniform(spark, monkeypatch):
    """Over seeds, every row meets every shard and every place equally often."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 4)
    df = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    seen = np.zeros((12, 3))
    for seed in range(40):
        for r in sharding.assign(df, 3, seed=seed).collect():
            seen[r.doc_id, r.shard] += 1
    assert ((seen - 40 / 3) ** 2 / (40 / 3)).sum() < 60  # 22 degrees of freedom


def test_matrix_margins_and_law():
    for seed in range(5):
        m = sharding.matrix([5, 0, 9, 7], [7, 7, 7], seed)
        assert m.sum(axis=1).tolist() == [5, 0, 9, 7] and m.sum(axis=0).tolist() == [7, 7, 7]
    draw = np.random.default_rng(1)
    large = [sharding.hypergeometric(draw, 10**9, 3 * 10**9, 4000) for _ in range(2000)]
    assert abs(np.mean(large) - 1000) < 4 and abs(np.std(large) - np.sqrt(750)) < 2
    assert sharding.hypergeometric(draw, 5, 0, 3) == 3 and sharding.hypergeometric(draw, 0, 5, 3) == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(0).alias("slot"))
    places = sharding.assign(df, 4)
    sharding.write(df, places, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, f"t{i}") for i in range(50)]
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in places.collect()}
