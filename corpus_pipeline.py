"""From documents to packed training sequences: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and decides about all rows its predecessor kept; ``run`` writes the
rows of a stage as Parquet and reads them again for the next. The language stage learns from the
labelled documents and rejects texts without a letter or without a likely language. Of each group of near
duplicates (five-word n-grams, Jaccard similarity 0.8 or more) the document with the smallest id stays. Passages of
50 words or more that an earlier document has are cut out; a document that loses all its words goes.
The rest is tokenised and packed.

Defined cases: documents with null or empty texts go in the first stage; null ids, repeated rows, other columns and
empty tables are handled as the operators say; the columns of the documents pass through every stage but the last."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope import session
from corpuscope.llm import common, jaccard, langid, packing, substring

LIKELY = 0.5        # least score of a predicted language
SEQUENCE = 1024     # tokens
SHORT_BATCH = 150   # texts whose sets and parts, several times their size, a worker holds at once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark, clean=True)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model, lang_pred="__lang", score="__score")
    return found.where((F.col("__lang") != langid.NO_LANGUAGE) & (F.col("__score") >= LIKELY)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark, batch_rows=SHORT_BATCH, clean=True)
    return jaccard.one_of_each(docs, n=5, threshold=Fraction(4, 5)).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark, clean=True)
    cut = substring.remove(docs, window=50).where("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark, clean=True)
    return packing.pack(packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE), SEQUENCE)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages),
          ("best_fit_packing", packed)]
ORACLE_SQL = None  # a learned language model, components and packing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.configure(spark, clean=True), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
