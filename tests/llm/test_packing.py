import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import bpe, packing
from corpuscope.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op3_packing"](spark, folder).collect()
    wanted = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*bpe.tokenizer(PATH).encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[r.doc_id, n] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted
    assert len(rows) == len(wanted)
    used = check_places(rows, 1024)
    assert used <= -(-sum(x[1] for x in wanted.values()) // 1024) * 1.01 + 2


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_rounds_join_what_fits(spark, parts):
    sizes = [513] * 300 + [200] * 300 + [100] * 300 + [64] * 50 + [64] * 7
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, length long, fill string").repartition(parts)
    rows = packing.pack(items, 64 * 16).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    lower = max(300, -(-sum(sizes) // 1024))
    assert check_places(rows, 1024) <= lower + 3


@pytest.mark.parametrize("parts", [1, 12])
def test_bins_meet_beyond_a_task(spark, monkeypatch, parts):
    """Sizes that come in order, in many more bins than one task takes."""
    monkeypatch.setattr(packing, "GROUP", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        sizes = [600] * 400 + [400] * 400
        items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long").repartitionByRange(parts, "doc_id")
        rows = packing.pack(items).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    assert check_places(rows, 1024) <= 400 * 1.1


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "word " * 5000, None)],
                               "doc_id long, text string, length string")
    rows = packing.pack(packing.cut(df, PATH)).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows if r.doc_id != 2) == [("1", 1), ("1", 1), ("None", 1)]
    assert sum(r.length for r in rows if r.doc_id == 2) == len(bpe.tokenizer(PATH).encode("word " * 5000).ids) + 1
    check_places(rows, 1024)
    empty = packing.pack(packing.cut(df.limit(0), PATH))
    assert empty.collect() == [] and "sequence_id" in empty.columns


def test_bad_lengths(spark):
    for bad in (None, 0, 2000):
        with pytest.raises(Exception, match="lengths must be"):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long")).collect()


def test_sequences_hold_the_tokens(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    pieces = packing.cut(df, PATH, capacity=3, with_ids=True)
    whole = packing.sequences(packing.pack(pieces.drop("ids"), 3), pieces)
    found = sorted(i for r in whole.collect() for i in r.ids)
    assert found == sorted(i for t in ("one two three", "four", "") for i in [*bpe.tokenizer(PATH).encode(t).ids, 2])
    assert whole.agg(F.max(F.size("ids"))).first()[0] <= 3
