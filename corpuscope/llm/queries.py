"""One query per operator of this subpackage, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope import session
from corpuscope.llm import bpe, decontaminate, jaccard, langid, licenses, negatives, packing, sharding, simhash, substring, suffix, topk, whiten
from corpuscope.llm.common import configure, table, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op1_bpe(spark, d):
    encoded = bpe.encode(table(spark, d, "documents"), vocabulary())
    digests = encoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"))
    decoded = bpe.decode(digests, vocabulary(), keep=("n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", sha256(F.col("text")).alias("decoded_sha256"))


@query
def op3_packing(spark, d):
    return packing.pack(packing.cut(table(spark, d, "documents"), vocabulary()))


@query
def op4_language_id(spark, d):
    rows = table(spark, d, "documents")
    model = langid.train(rows.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(rows.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_substring_dedup(spark, d):
    done = substring.remove(table(spark, d, "documents").select("doc_id", "text"))
    kept = F.when(F.col("n_removed") == 0, F.array_join(words(F.col("text")), " ")).otherwise(F.col("text"))
    return done.select("doc_id", "n_words", "n_removed", sha256(kept).alias("kept_sha256"))


@query
def op10_sharding(spark, d):
    return sharding.assign(table(spark, d, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_fingerprints(spark, d):
    """Both texts of a document are fingerprinted as rows of one table, told apart by ``which``."""
    shown = simhash.edited(table(spark, d, "documents")).withColumn("row", F.monotonically_increasing_id())
    both = shown.select("doc_id", "row", "n_chars", sha256(F.col("edited")).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t"))
    own = ["doc_id", "row", "n_chars", "edited_sha256", "which"]
    prints = simhash.votes(both.select(*own[:4], "t.which", "t.text"), own, "text")
    rows = prints.groupBy("doc_id", "row", "n_chars", "edited_sha256").agg(
        F.max(F.when(F.col("which") == 0, F.col("bits"))).alias("bits"), F.max(F.when(F.col("which") == 1, F.col("bits"))).alias("edited_bits"))
    slim = session.written(rows.drop("row"), "prints")
    pairs = simhash.with_next(slim, ["doc_id", "edited_sha256"], {"bits": "next_bits"})
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(F.col("bits")).alias("fingerprint"),
        simhash.as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        simhash.likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        simhash.likeness(F.col("bits"), F.col("next_bits")).alias("near_next"))


@query
def op5_topk_search(spark, d):
    vectors = table(spark, d, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


@query
def op9_license_scan(spark, d):
    return licenses.scan(table(spark, d, "documents"))


@query
def op6_jaccard_join(spark, d):
    configure(spark, clean=True)
    found = jaccard.linked(table(spark, d, "documents"), n=3, threshold=Fraction(9, 10))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_suffix_dedup(spark, d):
    done = suffix.remove(table(spark, d, "documents"), keep="none")
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_decontamination(spark, d):
    found = decontaminate.hits(table(spark, d, "documents"), table(spark, d, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query
def op12_whitening(spark, d):
    return whiten.whiten(table(spark, d, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


@query
def op11_hard_negatives(spark, d):
    rows = table(spark, d, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))
