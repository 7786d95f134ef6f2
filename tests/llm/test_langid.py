import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import langid
from corpuscope.llm.queries import QUERIES

EN = "the house of the man and the garden with the trees"
DE = "das haus des mannes und der garten mit den bäumen"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([(EN, "en")] * 6 + [(DE, "de")] * 4 + [(None, "en"), (EN, None)])]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op4_language_id"](spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(tested) < 350
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = spark.createDataFrame([(i, EN, "en") for i in range(40)], "doc_id long, text string, lang string")
    wrong = rows.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    model = langid.train(wrong.where(~langid.held_out(F.col("doc_id"))))
    assert model.languages == ["en"]


def test_defined_cases(spark, model):
    assert model.languages == ["en", "de"]
    texts = [None, "", "12 $%", "漢字", "The TREES", "bäumlein", "x" * 100_000, EN, EN, "́"]
    df = spark.createDataFrame([(i, t, 1, "old", "k") for i, t in enumerate(texts)],
                               "doc_id long, text string, score int, lang_pred string, extra string")
    rows = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0 and rows[9].lang_pred == "und"
    assert rows[3].lang_pred == "en" and rows[3].score == pytest.approx(0.6)  # nothing known: the share of the most frequent
    assert rows[4].lang_pred == "en" and rows[5].lang_pred == "de"
    assert rows[7] == rows[8].__class__(*[7, *rows[8][1:]]) and rows[7].extra == "k"


def test_backoff_order(model):
    known = model.word_score("haus")
    assert (known == model.word_logs[model.known["haus"]]).all()
    for n, level, logs in zip((4, 3, 2, 1), model.gram_known, model.gram_logs):
        word = {4: "hausen", 3: "qaus", 2: "qäuq", 1: "qh"}[n]
        rows = [level[g] for g in langid.grams(word, n) if g in level]
        longer = [g for m, other in zip((4, 3, 2, 1), model.gram_known) if m > n for g in langid.grams(word, m) if g in other]
        if rows and not longer:
            assert model.word_score(word) == pytest.approx(logs[rows].mean(axis=0))
    assert (model.word_score("漢") == 0).all()


def test_nothing_to_learn_or_to_predict(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.train(empty) is None
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, EN)], "doc_id long, text string"), None).collect()] == ["und"]
    assert langid.identify(empty, model).collect() == []
