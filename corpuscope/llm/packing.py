"""Packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing: items are dealt evenly over tasks, whatever partition they come from; every task
packs its items best-fit (largest first, each into the fullest sequence that still takes it) and
emits the sequences that are nearly full. The underfull ones travel as items of their own to the next
level of a tree, dealt evenly over an eighth of the tasks, where best-fit is repeated. Sequences that not even the
smallest one fits into leave on the way. The tree ends with one task. If more are left than one task may
hold, they are dealt again and again, each time in another way, until ``DEALINGS`` in a row join nothing.
Only slim rows travel (keys, start, length, checksum), never tokens. A task packs at most ``GROUP`` items
at a time, and a level never has fewer tasks than that takes, so memory is bounded at any size.

Defined cases: a null text counts as empty, and an empty text has only its end id; a document of
more than the capacity is cut, its first piece takes what is over; repeated rows and equal keys are
packed as separate items; null keys are packed and returned; other columns are left out, so no name
can clash; an empty table gives an empty result; an item with a null length, a length below 1, or above
the capacity raises an error, since it fits nowhere."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from corpuscope import session
from corpuscope.llm import bpe

GROUP = 200_000  # items that one task packs at a time
FAN_IN = 8       # tasks whose bins meet in one of the next level
DEALINGS = 3     # dealings in a row without a join after which several tasks stop


def cut(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", key: str = "doc_id",
        with_ids: bool = False) -> DataFrame:
    """The pieces of each document: key, piece, start, length, ids_crc32, and the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids = bpe.batch_ids(batch.column(1), path)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            closed = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(batch.num_rows + 1)
            sizes = np.diff(ends)
            counts = -(-sizes // capacity)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            first = (sizes - (counts - 1) * capacity)[rows]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            at = ends[rows] + start
            sums = [zlib.crc32(closed[a:a + n]) for a, n in zip(at, length, strict=True)]
            columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.append(at, ends[-1]), pa.int32()), pa.array(closed.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return df.select(key, bpe.words(F.col(text)).alias("__words")).mapInArrow(run, T.StructType(fields))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each size: largest first, each into the fullest bin that takes it."""
    bins = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that is left
    rooms = 0  # bit r is set while some bin has room r
    opened = 0
    for at in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[at])
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                rooms &= ~(1 << left)
        else:
            left, chosen = capacity, opened
            opened += 1
        bins[at] = chosen
        if left > size:
            room[left - size].append(chosen)
            rooms |= 1 << (left - size)
    return bins


def _packed(items: pa.Table, capacity: int, names: list[str]) -> pa.RecordBatch:
    """Items (fill, members) joined into bins."""
    sizes = items["fill"].to_numpy()
    if len(sizes) and (np.isnan(sizes.astype(float)).any() or sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    members = items["members"].combine_chunks().take(pa.array(order))
    firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
    ends = np.asarray(members.offsets)
    offsets = np.append(ends[firsts], ends[-1])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members.values)
    fill = np.add.reduceat(sizes[order], firsts) if len(firsts) else sizes[order]
    return pa.RecordBatch.from_arrays([pa.array(fill, pa.int64()), lists], names)


def _round(bins: DataFrame, capacity: int) -> DataFrame:
    """The bins of each task, with ``node`` (task), ``portion`` (of ``GROUP`` items) and ``slot``, which is unique in a portion."""
    names = ["fill", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, portion = [], 0, 0

        def done() -> pa.RecordBatch:
            out = _packed(pa.Table.from_batches(held), capacity, names)
            places = [pa.array(np.full(out.num_rows, portion)), pa.array(np.arange(out.num_rows))]
            return pa.RecordBatch.from_arrays([*out.columns, *places], [*names, "portion", "slot"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= GROUP:
                yield done()
                held, count, portion = [], 0, portion + 1
        if count:
            yield done()

    slim = bins.select(*names)
    schema = T.StructType([*slim.schema.fields, T.StructField("portion", T.LongType()), T.StructField("slot", T.LongType())])
    return slim.mapInArrow(run, schema).withColumn("node", F.spark_partition_id())


def _tasks(bins: int) -> int:
    """Tasks that hold at most ``GROUP`` of evenly dealt bins each, with some room for chance."""
    return 1 if bins <= GROUP else -(-bins * 5 // (GROUP * 4))


def _dealt(bins: DataFrame, tasks: int, *by: str | Column) -> DataFrame:
    return bins.repartition(tasks, *by) if tasks > 1 else bins.repartition(1)


def pack(items: DataFrame, capacity: int = 1024, length: str = "length", nearly_full: float = 0.996) -> DataFrame:
    """The items with ``sequence_id`` and ``offset``, their place in a sequence.

    A bin is nearly full, and final, from ``nearly_full`` of the capacity on."""
    if {"sequence_id", "offset"} & set(items.columns):
        raise ValueError("the items already have a column sequence_id or offset")
    final_from = int(np.ceil(nearly_full * capacity))
    single = items.select(F.col(length).cast("long").alias("fill"), F.array(F.struct(*items.columns)).alias("members"))
    start = session.written(single.withColumn("slot", F.monotonically_increasing_id()), "items")
    whole = start.where(F.col("fill") == capacity)  # fills a sequence alone
    loose = start.where(F.col("fill").isNull() | (F.col("fill") != capacity))
    tasks = max(_tasks(loose.count()), loose.rdd.getNumPartitions())
    level = session.written(_round(_dealt(loose, tasks, "slot"), capacity), "bins")
    finished = [whole.select("fill", "members")]
    dealing = idle = 0
    while True:
        finished.append(level.where(F.col("fill") >= final_from).select("fill", "members"))
        under = level.where(F.col("fill") < final_from)
        low = under.agg(F.min("fill")).first()[0]
        fits = F.col("fill") <= max(capacity - (low or 0), low or 0)  # with the smallest, or is the smallest
        finished.append(under.where(~fits).select("fill", "members"))
        under = under.where(fits)
        state = under.agg(F.count("*").alias("bins"), F.countDistinct("node", "portion").alias("nodes")).first()
        least = _tasks(state["bins"])
        if state["nodes"] <= 1 or idle == DEALINGS:
            break
        tasks = max(-(-tasks // FAN_IN), least)  # of the tasks asked for, so that the tree ends whoever deals more
        dealing += 1
        level = session.written(_round(_dealt(under, tasks, "node", "portion", "slot", F.lit(dealing)), capacity), "bins")
        idle = idle + 1 if tasks == least and level.count() == state["bins"] else 0
        if tasks == 1:  # all that was left has met
            under = level
            break
    finished.append(under.select("fill", "members"))
    bins = finished[0]
    for more in finished[1:]:
        bins = bins.unionByName(more)
    return placed(bins.withColumn("sequence_id", F.monotonically_increasing_id()), items, length)


def placed(bins: DataFrame, items: DataFrame, length: str) -> DataFrame:
    """One row per member of each bin, with its place."""
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(0), batch.column(1)
            rows = pc.list_parent_indices(lists)
            members = lists.flatten()
            columns = [members.field(name) for name in names]
            sizes = columns[names.index(length)].to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            firsts = (np.asarray(lists.offsets) - lists.offsets[0].as_py())[:-1]
            offset = before - before[firsts][rows.to_numpy()] if len(sizes) else before
            yield pa.RecordBatch.from_arrays([*columns, ids.take(rows), pa.array(offset, pa.int64())],
                                             [*names, "sequence_id", "offset"])

    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return bins.select("members", "sequence_id").mapInArrow(run, schema)


def sequences(placements: DataFrame, pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The token ids of each sequence: pieces with their ``ids`` joined to their places by unique,
    non-null keys. A sequence holds at most the capacity, so each group is bounded."""
    at = placements.select(*keys, "sequence_id", "offset")
    parts = at.join(pieces.select(*keys, "ids"), list(keys)).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
