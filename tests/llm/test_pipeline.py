import re
from fractions import Fraction

import numpy as np
import zlib
import corpus_pipeline
import __spark_entry__ as entry
import test_jaccard
import test_substring
from corpuscope import session
from corpuscope.llm import bpe, langid
from test_packing import PATH, check_places


def test_registered_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(session.written(stage(spark, tables[-1], folder), name))
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    for t in tables[1:-1]:
        assert t.schema == docs.schema or [f.name for f in t.schema] == docs.columns
    # Language: every document has letters and a clear language here.
    assert sorted(rows[1]) == sorted(rows[0])
    # Near duplicates: the smallest id of each component.
    stay = {key for key, _, low in test_jaccard.brute(rows[1], 5, Fraction(4, 5)) if key == low}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if str(r[0]) in stay) and len(rows[2]) < len(rows[1])
    # Passages.
    cut = {key: (words, gone, kept) for key, words, gone, kept in test_substring.brute(rows[2], 50)}
    left = dict(rows[3])
    assert set(left) == {key for key, _ in rows[2] if cut[str(key)][1] < cut[str(key)][0]}
    for key, text in rows[2]:
        if key in left:
            words, gone, _ = cut[str(key)]
            assert left[key] == text if gone == 0 else len(re.findall(r"\S+", left[key])) == words - gone
    assert all(r.n_chars == len(r.text) for r in tables[3].collect() if cut[str(r.doc_id)][1])
    # Packing.
    placed = tables[4].collect()
    check_places(placed, 1024)
    for key, text in rows[3]:
        ids = np.array([*bpe.tokenizer(PATH).encode(text).ids, 2], "<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in placed if r.doc_id == key)
        assert [x[1] for x in own] == [0, *np.cumsum([x[2] for x in own])[:-1].tolist()] and sum(x[2] for x in own) == len(ids)
        assert all(zlib.crc32(ids[a:a + n].tobytes()) == c for _, a, n, c in own)


def test_run_and_odd_rows(spark, tmp_path):
    text = "the house of the man and the garden " * 3
    rows = [(1, text, "en", "s", 1), (2, text, "en", None, 2), (2, text, "en", None, 2), (None, text + " more words here now", None, "s", None),
            (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "123 456", "en", "s", 7), (6, "something else in the house of the garden", "en", "s", 9),
            (7, "zwei drei vier das haus", "de", "s", 3)]
    rows += [(100 + i, f"the man {i} and the house", "en", "s", 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in found}
    assert {1, 6, 7} <= ids and not ids & {2, 3, 4, 5}
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_language_stage_rejects(spark):
    rows = [(i, "the house of the man", "en") for i in range(20)] + [(90, "12 34", "en"), (91, None, "en"), (92, "der man", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {*range(20), 92} and kept.columns == df.columns
    assert langid.NO_LANGUAGE == "und"
