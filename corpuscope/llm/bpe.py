"""Byte-pair encoding and decoding through tables of distinct words.

Spark splits every text into words; a task gathers the distinct words of its rows in a table,
encodes each of them once, and joins the ids back to the positions of the words. Decoding joins
ids to their pieces and concatenates the pieces of each row.

A word here ends before a single blank between two visible characters, or after a single line feed
before a visible character. Byte-level vocabularies always break a text there, so the
ids of the words, one after the other, are the ids of the text; what the vocabulary breaks further
(punctuation, special tokens, runs of white space) it breaks inside the word.

Defined cases: a null text counts as empty and has no ids; null ids decode to an empty text; bytes
that are not UTF-8 decode to U+FFFD, as the tokenizers library does; ids outside the vocabulary
decode to nothing; repeated rows stay, each with its own result; key columns are returned as they
are, nulls included, and all other columns are left out, so no name can clash. An empty table gives
an empty result."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# The test that most places fail comes first.
WORD_BREAK = r"(?U)(?=\x20\S)(?<=\S)|(?<=\n)(?=\S)(?<=\S\n)"
# Fixed value: how byte-level vocabularies of this kind break a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 500  # characters
CACHED_WORDS = 400_000  # words a worker keeps between batches; more only means encoding them again

_TOKENIZERS: dict[str, object] = {}
_RANKS: dict[str, tuple | None] = {}
_CACHES: dict[str, dict[str, bytes]] = {}
_PIECES: dict[str, pa.Array] = {}


def words(text: Column) -> Column:
    """The words of a text, in order; concatenated they are the text."""
    return F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1)


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _TOKENIZERS[path] = loaded
    return _TOKENIZERS[path]


def ranks(path: str):
    """The same vocabulary as ranks, which encode a joined text of many words several times faster;
    None unless the merges are in the order of their ids, as ranks take them to be."""
    if path not in _RANKS:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocabulary = model["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        plain = model.get("normalizer") is None and not model["pre_tokenizer"].get("add_prefix_space") and len(special) == 1
        found = None
        if plain and made == sorted(made) and len(made) + 256 + len(special) == len(vocabulary.keys() | special.keys()):
            bytes_of = byte_map()
            table = {bytes(bytes_of[c] for c in piece): at for piece, at in vocabulary.items() if piece not in special}
            found = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special), *special.items()
        _RANKS[path] = found
    return _RANKS[path]


def encoded_words(new: list[str], path: str) -> list[bytes]:
    """The ids of words, as 32-bit integers. The special token parts the words of a joined text; words that
    hold it, or are very long, are encoded one by one."""
    found = ranks(path)
    out: list[bytes] = [b""] * len(new)
    short = [] if found is None else [i for i, word in enumerate(new) if len(word) <= LONG_WORD and found[1][0] not in word]
    if short:
        encoding, (mark, mark_id) = found
        ids = encoding.encode_to_numpy(mark.join([new[i] for i in short]), allowed_special={mark}).astype("<u4", copy=False)
        cuts = np.flatnonzero(ids == mark_id)
        data = ids.tobytes()
        for i, a, b in zip(short, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)], strict=True):
            out[i] = data[a:b]
    done = set(short)
    rest = [i for i in range(len(new)) if i not in done]
    for i, x in zip(rest, tokenizer(path).encode_batch_fast([new[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.array(x.ids, "<u4").tobytes()
    return out


def word_ids(distinct: list[str], path: str) -> list[bytes]:
    """The ids of each of some distinct words; words seen in earlier batches come from the cache."""
    cache = _CACHES.setdefault(path, {})
    new = [word for word in distinct if word not in cache]
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = distinct
    cache.update(zip(new, encoded_words(new, path), strict=True))
    return [cache[word] for word in distinct]


def batch_ids(lists: pa.ListArray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of rows of words: row i has ids[offsets[i]:offsets[i + 1]]."""
    coded = lists.flatten().dictionary_encode()
    starts_of_rows = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    if not len(coded):
        return np.zeros(len(lists) + 1, np.int64), np.empty(0, np.int32)
    table = word_ids(coded.dictionary.to_pylist(), path)
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    ids_of_words = np.frombuffer(b"".join(table), "<i4")
    starts = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    positions = np.repeat(starts[codes] - ends[:-1], sizes)
    positions += np.arange(len(positions))
    return ends[starts_of_rows], ids_of_words[positions]


def _fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[key] for key in keys]


def encode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The key columns and the token ids of each text (array of int), one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, found = batch_ids(batch.column(len(keys)), path)
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], column], [*keys, ids])

    schema = T.StructType([*_fields(df, list(keys)), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*keys, words(F.col(text)).alias("__words")).mapInArrow(run, schema)


def byte_map() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def pieces(path: str) -> pa.Array:
    """The bytes of every id of a byte-level vocabulary, at the place of the id."""
    if path not in _PIECES:
        byte_of = byte_map()
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, at in vocabulary.items():
            known = all(c in byte_of for c in piece)
            table[at] = bytes(byte_of[c] for c in piece) if known else piece.encode()
        _PIECES[path] = pa.array([*table, b""], pa.large_binary())
    return _PIECES[path]


def decode(df: DataFrame, path: str, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), text: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """The key columns, the columns in ``keep`` and the text of each row of ids."""
    carried = [*keys, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        unknown = len(table) - 1
        for batch in batches:
            lists = batch.column(len(carried))
            wanted = np.asarray(lists.flatten().fill_null(unknown)).astype(np.int64)
            wanted[(wanted < 0) | (wanted > unknown)] = unknown
            joined = table.take(pa.array(wanted))
            ends = np.concatenate([[0], np.cumsum(pa.compute.binary_length(joined).to_numpy(zero_copy_only=False))])
            data = b"".join([x for x in [joined.buffers()[2]] if x is not None])
            base = int(np.frombuffer(joined.buffers()[1], np.int64, 1, joined.offset * 8)[0]) if len(joined) else 0
            rows = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()] + base
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carried)], pa.array(texts, pa.string())], [*carried, text])

    schema = T.StructType([*_fields(df, carried), T.StructField(text, T.StringType())])
    return df.select(*carried, F.coalesce(ids, F.array().cast("array<int>")).alias("__ids")).mapInArrow(run, schema)
