"""Removal of passages that an earlier document already has, by level-wise doubling.

A passage is a window of ``window`` words. Windows of half the length are looked at first, one anchor
per window, chosen by content (see ``windows``). Only where such a short window is found in two
documents, it is extended to twice its length:

1. short windows: an anchor that one document alone has is dropped, and with it all its windows;
2. stretches: the windows around one anchor are compared as one piece; a document whose stretch an
   earlier one has in the same shape loses all of it, the first document keeps it for now;
3. windows: only the first stretches of anchors that come with several shapes are taken apart, and
   each window is compared by itself.

The cascade ends as soon as no candidates survive. Hashes of a level are counted per task before they
are shuffled, the largest count of a group is never gathered, and joins split skewed keys. Texts are
shuffled at most twice, for the documents whose stretches are taken apart and for the removal itself.

A word is a run of anything but ASCII white space, as it stands. Windows are judged on the input, not on
what is left. Equality is that of 128 bits of hashes.

Defined cases: a null text has no words and stays null; a document of fewer words than a window is left
alone; rows with the same id are one document as far as "earlier" goes, so they don't empty each other;
rows without id come after all others, and equal texts among them stay; other columns are kept, and a
column named like a result column is replaced. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session
from corpuscope.llm import common, windows as w

LAST = (1 << 63) - 1  # stands for a missing id: after all others


def word_hashes(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, a 64-bit hash per word); the words are hashed once per batch."""
    coded = lists.flatten().dictionary_encode()
    table = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    symbols = table[codes] if len(codes) else np.empty(0, np.uint64)
    return np.asarray(lists.offsets) - lists.offsets[0].as_py(), w.mixed(symbols)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _stretches(docs: DataFrame, window: int, short: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, symbols = word_hashes(batch.column("words"))
            for s in w.bounded_stretches(lambda a, b: symbols[a:b], offsets, window, short):
                row = pa.array(s["row"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("digest").take(row), _signed(s["anchor"]), _signed(s["content"]),
                     pa.array(s["start"], pa.int32()), pa.array(s["count"], pa.int32())],
                    ["id", "digest", "anchor", "content", "start", "count"])

    return docs.mapInArrow(run, "id long, digest long, anchor long, content long, start int, count int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """The windows of the stretches ``parts`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, symbols = word_hashes(batch.column("words"))
            parts = batch.column("parts")
            each = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(parts.offsets)))
            start, count = (each.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "count"))
            of = np.repeat(np.arange(len(start)), count)
            place = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            row = row[of]
            hashes = w.Hashes(symbols).of(offsets[row] + place, window) if len(of) else np.empty(0, np.uint64)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("digest").take(at), each.field("anchor").take(pa.array(of)),
                 _signed(hashes), pa.array(place, pa.int32())], ["id", "digest", "anchor", "window", "start"])

    return docs.mapInArrow(run, "id long, digest long, anchor long, window long, start int")


def repeated(df: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Word ranges that an earlier document has too: id, digest (of the text), ranges [start, end)."""
    if window < 2:
        raise ValueError("a window has two words or more")
    short = -(-window // 2)
    docs = df.select(_id(key).alias("id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    split = common.words(F.col("text")).alias("words")
    every = session.written(_stretches(docs.select("id", "digest", split), window, short), "stretches")
    # 1. Short windows in two documents.
    anchors = every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    alive = session.written(every.join(anchors.select("anchor"), "anchor"), "alive")
    # 2. Whole stretches: the first document of each shape stands for it.
    shapes = session.written(alive.groupBy("anchor", "content").agg(F.min("id").alias("first"), F.first("count").alias("count")), "shapes")
    later = alive.join(shapes.select("anchor", "content", "first"), ["anchor", "content"]).where("id > first").select(
        "id", "digest", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end"))
    # 3. Windows of the anchors that come in several shapes.
    several = shapes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    first = alive.join(shapes.join(several, "anchor").select("anchor", "content", "first"), ["anchor", "content"]).where("id = first")
    parts = first.groupBy("id", "digest").agg(F.collect_list(F.struct("anchor", "start", "count")).alias("parts"))
    # Texts meet by a shuffle at every size, and are split into words only then.
    taken = docs.join(session.written(parts, "parts").hint("merge"), ["id", "digest"]).select("id", "digest", "parts", split)
    each = session.written(_windows(taken, window), "windows")
    lowest = each.groupBy("anchor", "window").agg(F.min("id").alias("first"))
    single = each.join(lowest, ["anchor", "window"]).where("id > first").select(
        "id", "digest", "start", (F.col("start") + window).alias("end"))
    return later.unionByName(single).groupBy("id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


RESULT = "struct<text: string, n_words: bigint, n_removed: bigint, spans: array<struct<start: int, end: int>>>"


def remove(df: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows with their ``text`` after the removal (kept words joined by one blank where words were removed,
    else as it was), ``n_words``, ``n_removed`` and the removed ``spans`` of words."""
    ranges = session.written(repeated(df, window, text, key).withColumnsRenamed({"id": "__id", "digest": "__digest", "ranges": "__ranges"}), "ranges")
    marked = df.withColumns({"__id": _id(key), "__digest": _digest(text)}).join(ranges.hint("merge"), ["__id", "__digest"], "left")

    @F.arrow_udf(RESULT)
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(texts, found, strict=True):
            value, spans = value.as_py(), spans.as_py()
            parts = [] if value is None else value.encode().split()
            if not spans:
                out.append((value, len(parts), 0, []))
                continue
            starts, ends = w.union(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
            kept, at = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                kept += parts[at:a]
                at = b
            kept += parts[at:]
            out.append((b" ".join(kept).decode(), len(parts), len(parts) - len(kept),
                        [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
        texts, n_words, n_removed, spans = zip(*out, strict=True) if out else ((), (), (), ())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span)],
            ["text", "n_words", "n_removed", "spans"])

    done = marked.withColumn("__cut", cut(F.col(text), F.col("__ranges")))
    return done.withColumns({text: done["__cut"]["text"], "n_words": done["__cut"]["n_words"], "n_removed": done["__cut"]["n_removed"],
                             "spans": done["__cut"]["spans"]}).drop("__id", "__digest", "__ranges", "__cut")
