"""Removal of byte strings that occur more than once, with suffix order and longest previous factors.

Strings of ``window`` bytes are compared wherever they start, in all documents. A document keeps or loses
bytes by two rules: ``keep="first"`` removes what an earlier place (by id, then by position) has too, and
``keep="none"`` removes every copy, the first one included.

1. Anchors (see ``windows``): of every window the run of ``short`` bytes with the smallest hash. A
   stretch whose anchor occurs once has no repeated window. Anchors are counted per task before they move.
2. Stretches that are equal as a whole are settled by counting; one of each *shape* goes on, if its anchor comes
   in several shapes.
3. The shapes of an anchor meet in one task, where their windows are put in suffix order (ranks by doubling). The
   previous and the next smaller position in that order, with the common prefixes on the way, give the longest
   previous factor of each position; with larger positions, the longest next factor. Where it reaches the
   window, the window occurs earlier, or later.
4. An anchor with more than ``GROUP_BYTES`` of shapes is not sorted in one task: its stretches are cut again with
   a longer anchor, up to the window itself, where shapes are settled by counting alone. So a line that a third of
   all documents have gives no large group, and memory is bounded.

Matches never cross documents. Windows are judged on the input, not on what is left. Step 2 compares
128 bits of hashes, step 3 bytes.

Defined cases: a null text has no bytes; a text below the window keeps all; rows without id come after all others;
rows that repeat id and text are places like any others for ``keep="none"``, and one place for ``keep="first"``;
other columns are left out, so no name can clash; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session
from corpuscope.llm import windows as w
from corpuscope.llm.substring import _digest, _id

GROUP_BYTES = 1 << 18

SYMBOLS = w.mixed(np.arange(1, 257, dtype=np.uint64) * w.BASE)


# --- suffix order -------------------------------------------------------------------------------


def ranks(data: np.ndarray, limit: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every position by its first ``length`` bytes), up to ``limit``; behind the end is least."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    key, length = np.zeros(n, np.uint64), 0
    for at in range(min(4, limit)):
        key = key * np.uint64(257) + padded[at:at + n]
        length += 1
    found = [(1, data), (length, _dense(key))]
    while length < limit:
        step = min(length, limit - length)
        rank = found[-1][1].astype(np.uint64)
        behind = np.zeros(n, np.uint64)
        behind[: max(0, n - step)] = rank[step:] + np.uint64(1)
        found.append((length + step, _dense(rank * np.uint64(n + 2) + behind)))
        length += step
    return found


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])) if len(keys) else rank
    return rank


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` share, at most the length of the last level."""
    n, limit = len(levels[0][1]), levels[-1][0]
    whole = levels[-1][1][a] == levels[-1][1][b]
    length = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        while True:
            at, bt = a + length, b + length
            inside = (at < n) & (bt < n) & (length + size <= limit) & ~whole
            same = np.zeros(len(a), bool)
            same[inside] = rank[at[inside]] == rank[bt[inside]]
            if not same.any():
                break
            length += np.where(same, size, 0)
    return np.where(whole, limit, length)


def nearest_smaller(values: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the nearest earlier entry with a smaller value (-1: none), and the least of ``shared`` on the
    way; ``shared[i]`` is between entries i - 1 and i. Entries jump over those that are larger, all at once."""
    at = np.arange(len(values)) - 1
    least = shared.copy()
    moving = np.flatnonzero(at >= 0)
    while len(moving):
        moving = moving[values[at[moving]] > values[moving]]
        over = at[moving]
        least[moving] = np.minimum(least[moving], least[over])
        at[moving] = at[over]
        moving = moving[at[moving] >= 0]
    least[at < 0] = 0
    return at, least


def previous_factors(positions: np.ndarray, order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The longest previous factor of each entry of ``positions``: the longest prefix that a smaller position has.
    ``order`` is the suffix order of the entries, ``shared`` the common prefixes of neighbours in it."""
    placed = positions[order]
    before = nearest_smaller(placed, shared)[1]
    behind = nearest_smaller(placed[::-1], np.append(0, shared[:0:-1]))[1][::-1]
    found = np.empty(len(positions), np.int64)
    found[order] = np.maximum(before, behind)
    return found


def repeats(data: np.ndarray, positions: np.ndarray, window: int, keep: str) -> np.ndarray:
    """Which of the positions start a window that an earlier one (or, for "none", any other) starts too."""
    levels = ranks(data, window)
    order = np.lexsort((positions, levels[-1][1][positions]))
    placed = positions[order]
    shared = np.append(0, common_prefix(levels, placed[:-1], placed[1:])) if len(placed) else np.empty(0, np.int64)
    found = previous_factors(positions, order, shared) >= window
    if keep == "none":
        found |= previous_factors(-positions, order, shared) >= window
    return found


# --- stretches of documents ------------------------------------------------------------------------


def _bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of binary values without nulls, and the offsets of its rows."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
    held = data.buffers()[2]
    flat = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


PLACE = "id long, digest long, start int, count int, anchor long, content long"


def _of_documents(docs: DataFrame, window: int, short: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _bytes(batch.column("data"))
            for s in w.bounded_stretches(lambda a, b: SYMBOLS[flat[a:b]], offsets, window, short):
                row = pa.array(s["row"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("digest").take(row), pa.array(s["start"], pa.int32()),
                     pa.array(s["count"], pa.int32()), _signed(s["anchor"]), _signed(s["content"])],
                    ["id", "digest", "start", "count", "anchor", "content"])

    return docs.mapInArrow(run, PLACE)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """The bytes of the stretches ``parts`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _bytes(batch.column("data"))
            data = flat.tobytes()
            parts = batch.column("parts")
            each = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(parts.offsets)))
            start, count = (each.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "count"))
            at = (offsets[row] + start).tolist()
            size = (count + (window - 1)).tolist()
            cut = pa.array([data[a:a + n] for a, n in zip(at, size, strict=True)], pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("digest").take(take), each.field("start"), each.field("count"),
                 each.field("anchor"), each.field("content"), cut], ["id", "digest", "start", "count", "anchor", "content", "data"])

    return docs.mapInArrow(run, PLACE + ", data binary")


def _again(parts: DataFrame, window: int, short: int) -> DataFrame:
    """Stretches by a longer anchor inside stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = _bytes(batch.column("data"))
            data = flat.tobytes()
            for s in w.bounded_stretches(lambda a, b: SYMBOLS[flat[a:b]], offsets, window, short):
                row = pa.array(s["row"])
                first = batch.column("start").take(row).to_numpy() + s["start"]
                at = offsets[s["row"]] + s["start"]
                cut = [data[a:a + n] for a, n in zip(at.tolist(), (s["count"] + (window - 1)).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("digest").take(row), pa.array(first, pa.int32()),
                     pa.array(s["count"], pa.int32()), _signed(s["anchor"]), _signed(s["content"]), pa.array(cut, pa.binary())],
                    ["id", "digest", "start", "count", "anchor", "content", "data"])

    return parts.select("id", "digest", "start", "count", "anchor", "content", "data").mapInArrow(run, PLACE + ", data binary")


RANGE = "id long, digest long, start int, end int"


def _sorted_groups(parts: DataFrame, window: int, keep: str) -> DataFrame:
    """Ranges of windows found by suffix order, of shapes sorted by anchor and place."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = rows["data"].chunk(0)
        flat, offsets = _bytes(column)
        count = rows["count"].to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeats(flat, offsets[of] + inside, window, keep)
        of, inside = of[hit], inside[hit]
        new = np.append(True, (np.diff(of) != 0) | (np.diff(inside) != 1)) if len(of) else np.empty(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(of) - 1) if len(first) else first
        row = pa.array(of[first])
        base = rows["start"].to_numpy().astype(np.int64)[of[first]]
        return pa.RecordBatch.from_arrays(
            [rows["id"].chunk(0).take(row), rows["digest"].chunk(0).take(row), pa.array(base + inside[first], pa.int32()),
             pa.array(base + inside[last] + window, pa.int32())], ["id", "digest", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            size += batch.column("data").nbytes
            if size >= GROUP_BYTES:
                anchors = held["anchor"].to_numpy()
                edge = int(np.flatnonzero(anchors == anchors[-1])[0])  # the last anchor may go on
                if edge:
                    yield settle(held.slice(0, edge))
                    held = held.slice(edge)
                    size = held.nbytes
        if held is not None and len(held):
            yield settle(held)

    return parts.select("id", "digest", "start", "count", "anchor", "data").mapInArrow(run, RANGE)


def repeated(df: DataFrame, window: int = 400, keep: str = "first", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Byte ranges to remove: id, digest (of the text), ranges [start, end)."""
    if keep not in ("first", "none") or window < 4:
        raise ValueError('keep is "first" or "none"; a window has four bytes or more')
    docs = df.select(_id(key).alias("id"), _digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    places = session.written(_of_documents(docs, window, window // 4), "stretches")
    anchors = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = session.written(places.join(anchors, "anchor"), "alive")
    found = []
    for level in (1, 2, 3, 4):
        shapes = session.written(places.groupBy("anchor", "content").agg(
            F.min(F.struct("id", "digest", "start")).alias("at"), F.count("*").alias("n"), F.first("count").alias("count")), "shapes")
        if keep == "none":
            equal = places.join(shapes.where("n > 1").select("anchor", "content"), ["anchor", "content"])
        else:
            equal = places.join(shapes.where("n > 1").select("anchor", "content", "at"), ["anchor", "content"]).where(
                F.struct("id", "digest", "start") > F.col("at"))
        found.append(equal.select("id", "digest", "start", (F.col("start") + F.col("count") + (window - 1)).alias("end")))
        if level == 4:  # the anchor is the window: every anchor has one shape
            break
        sizes = shapes.groupBy("anchor").agg(F.count("*").alias("shapes"), F.sum(F.col("count") + (window - 1)).alias("bytes")).where("shapes > 1")
        several = shapes.join(sizes, "anchor").select("anchor", "content", "at.*", "count", (F.col("bytes") > GROUP_BYTES).alias("hot"))
        if level == 1:
            lists = several.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "count", "anchor", "content")).alias("parts"))
            texts = docs.join(session.written(lists, "parts").hint("merge"), ["id", "digest"])
            cut = _cut(texts.select("id", "digest", "data", "parts"), window).join(several.select("anchor", "content", "hot"), ["anchor", "content"])
        else:
            cut = places.join(several, ["anchor", "content", "id", "digest", "start", "count"])
        cut = session.written(cut.dropDuplicates(["anchor", "content"]), "cut")
        small = cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "id", "digest", "start")
        found.append(session.written(_sorted_groups(small, window, keep), "sorted"))
        places = session.written(_again(cut.where("hot"), window, window * (level + 1) // 4), "places")
        if places.isEmpty():
            break
    ranges = found[0]
    for more in found[1:]:
        ranges = ranges.unionByName(more)
    return ranges.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def _removed() -> Column:
    @F.arrow_udf("struct<kept: binary, n_bytes: bigint, n_removed: bigint, spans: array<struct<start: int, end: int>>>")
    def cut(data: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for value, spans in zip(data, found, strict=True):
            value, spans = value.as_py(), spans.as_py() or []
            starts, ends = w.union(np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64))
            kept, at = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(value[at:a])
                at = b
            kept = b"".join([*kept, value[at:]])
            out.append((kept, len(value), len(value) - len(kept),
                        [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
        kept, n_bytes, n_removed, spans = zip(*out, strict=True) if out else ((), (), (), ())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span)],
            ["kept", "n_bytes", "n_removed", "spans"])

    return cut(F.col("data"), F.col("ranges"))


def remove(df: DataFrame, window: int = 400, keep: str = "first", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ``kept`` (the remaining bytes, which a cut may leave without whole characters), n_bytes, n_removed and the
    removed ``spans`` of each row."""
    ranges = session.written(repeated(df, window, keep, text, key), "ranges")
    docs = df.select(F.col(key), _id(key).alias("id"), _digest(text).alias("digest"),
                     F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    joined = docs.join(ranges.hint("merge"), ["id", "digest"], "left")
    return joined.withColumn("x", _removed()).select(F.col(key), "x.*")
