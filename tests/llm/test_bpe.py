import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import bpe
from corpuscope.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a <|endoftext|>b <|endoftext|> c\n\n d  e\t f\n", "  \n ", "<|endoftext|>", "\n", " \n x", "a\n b \n\nc",
         "x y  z 'll I'm it's\r\n\r\n k", "é́ ñ 漢字 ١٢ 🙂🙂 a\u0085b", "w " * 30_000, "q" * 20_000, "same text", "same text"]


def both(df):
    return bpe.decode(bpe.encode(df, PATH), PATH, keep=("ids",))


def test_as_the_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = {r.doc_id: r for r in both(df).collect()}
    assert len(rows) == len(TEXTS)
    for key, text in enumerate(TEXTS):
        wanted = bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids
        assert rows[key].ids == wanted
        assert rows[key].text == (text or "") == bpe.tokenizer(PATH).decode(wanted, skip_special_tokens=False)


def test_every_character(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}  {c}\n{c}b" for c in points[i:i + 2000]) for i in range(0, len(points), 2000)]
    rows = {r.doc_id: r for r in both(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for key, text in enumerate(texts):
        assert rows[key].ids == bpe.tokenizer(PATH).encode(text, add_special_tokens=False).ids
        assert rows[key].text == text


def test_odd_ids_and_null_keys(spark):
    df = spark.createDataFrame([(None, [64, 127, 50256]), (1, None), (2, [-1, 99999, None, 64]), (2, [128])], "doc_id long, ids array<int>")
    found = sorted((str(r.doc_id), r.text) for r in bpe.decode(df, PATH).collect())
    piece = bpe.pieces(PATH)
    assert found == sorted([("None", (piece[64].as_py() + piece[127].as_py()).decode("utf-8", "replace") + "<|endoftext|>"),
                            ("1", ""), ("2", piece[64].as_py().decode()), ("2", piece[128].as_py().decode("utf-8", "replace"))])


def test_empty_table(spark):
    assert both(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = bpe.tokenizer(PATH).encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
