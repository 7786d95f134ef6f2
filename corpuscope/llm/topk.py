"""Exact top-k search by inner product, with a uniform threshold in three phases.

A vector is cut into ``slices``; each slice of it gives a partial score, and the score is their sum.
Queries and candidates are kept as blocks, and a task meets some candidate blocks with some query blocks, pair by
pair. The pairs are a Cartesian product that reads the blocks again for each of its tasks: no copy of a block goes
through the driver or a shuffle, however many pairs there are.

1. Every task gathers, per query and slice, the candidates with the highest partial scores. Their exact
   scores are computed, and the (k + 1)-th highest over all tasks is a cutoff that the score of no answer lies below.
2. The cutoff goes back to all blocks of the query, divided by the number of slices: a candidate whose
   partial scores all lie below that share has a score below the cutoff. The entries at or above the share
   are sufficient.
3. What such entries lack from the other slices is looked up in the block, and the exact scores at or
   above the cutoff remain, of which the best k are taken.

Components are rounded down to whole numbers (``floor(scale * x)``), so scores are exact integers.
A vector is kept as bytes, whole numbers without the zeros at the end, which change no score, so vectors that
differ in them alone are equal. Equal vectors are one candidate with its k + 1 smallest ids, enough for every
answer, so copies of a vector, however many, are neither compared nor shipped more than once. Equal queries are
searched once.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no part, nor do
rows without id; rows of the same id and vector are one; if vectors differ in length, the shorter count
as filled up with zeros; ties go to the smaller id; fewer than k candidates give fewer rows; an
empty table gives an empty result. Components beyond 2**53 / scale are refused, as are scores beyond 2**62."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpuscope import session

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
PAIRS = 256     # pairs of blocks that are worth a task
TASKS = 2000    # of a product, as each takes some of the driver's memory
LOWEST = -(1 << 62)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a vector that takes no part."""
    wide = F.transform(vector.cast("array<double>"), lambda x: x)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(wide.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _dense(column: pa.ListArray, slices: int) -> list[np.ndarray]:
    """A block of vectors as one matrix, filled up with zeros to a multiple of the slices."""
    lists = column.flatten()
    sizes = np.diff(np.asarray(lists.offsets))
    width = max(1, -(-max(sizes, default=1) // slices)) * slices
    out = np.zeros((len(lists), width))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _same(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that have it."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]))


def _as_bytes(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, pa.Array]:
    """The places of the vectors that take part, and each of them as bytes: the size of a number, then
    floor(scale * x) of every component up to the last that is not zero, in the smallest size that holds them."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    offsets = np.asarray(vectors.offsets).astype(np.int64) - vectors.offsets[0].as_py()
    pieces = []
    for width, at in _same(np.diff(offsets)):
        x = flat[offsets[at][:, None] + np.arange(width)]
        good = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.floor(x[good] * float(scale))
        peak = np.abs(x).max(axis=1, initial=0)
        length = np.where(x != 0, np.arange(1, width + 1), 0).max(axis=1, initial=0)
        size = 1 << np.searchsorted([2.0**7, 2.0**15, 2.0**31], peak, side="right")
        x = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        for both, some in _same(length * 16 + size):
            n, item = divmod(both, 16)
            data = np.ascontiguousarray(x[some, :n].astype(f"<i{item}")).view(np.uint8).reshape(len(some), n * item)
            pieces.append((at[good][some], np.concatenate([np.full((len(some), 1), item, np.uint8), data], axis=1)))
    sizes = np.zeros(len(vectors), np.int64)
    for at, data in pieces:
        sizes[at] = data.shape[1]
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for at, data in pieces:
        out[(ends - sizes)[at][:, None] + np.arange(data.shape[1])] = data
    kept = np.flatnonzero(sizes)
    starts = np.concatenate([[0], ends[kept]]).astype(np.int32)
    return kept, pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(starts), pa.py_buffer(out)])


def _matrix(vectors: pa.BinaryArray) -> np.ndarray:
    """Vectors as bytes, as a matrix filled up with zeros, in the smallest size that holds them."""
    data = np.frombuffer(vectors.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset:vectors.offset + len(vectors) + 1].astype(np.int64)
    item, sizes = data[offsets[:-1]].astype(np.int64), np.diff(offsets) - 1
    out = np.zeros((len(vectors), (sizes // item).max()), f"<i{item.max()}")
    for both, at in _same(sizes * 16 + item):
        size, i = divmod(both, 16)
        rows = np.ascontiguousarray(data[offsets[at][:, None] + np.arange(1, size + 1)])
        out[at, :size // i] = rows.view(f"<i{i}").reshape(len(at), size // i)
    return out


def _whole(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = _as_bytes(batch.column("values"), scale)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(kept)), values], ["id", "values"])
    return run


def _gather(rows: int, numbers: list[str]):
    """Blocks of so many rows: each of the numbers, and the vectors as one matrix."""
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        matrix = _matrix(table.column("values").chunk(0))
        made = [table.column(x).to_numpy().astype("<i8").tobytes() for x in numbers]
        return pa.RecordBatch.from_pydict({x: pa.array([v], pa.binary()) for x, v in zip(numbers, made)} | {
            "item": pa.array([matrix.itemsize], pa.int32()), "matrix": pa.array([matrix.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, rows - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)
    return run


def _blocks(df: DataFrame, rows: int, label: str, numbers: list[str]) -> DataFrame:
    """The rows (numbers, values) of each partition gathered into blocks."""
    fields = ", ".join([*(f"{x} binary" for x in numbers), "item int", "matrix binary"])
    made = df.select(*numbers, "values").mapInArrow(_gather(rows, numbers), fields)
    return made.select(*(F.col(x).alias(f"{label}_{x}") for x in made.columns))


def _held(batch: pa.RecordBatch, label: str, row: int, *numbers: str) -> list[np.ndarray]:
    """The numbers and the matrix of a block."""
    one = [np.frombuffer(batch.column(f"{label}_{x}")[row].as_buffer(), "<i8") for x in numbers]
    item = batch.column(f"{label}_item")[row].as_py()
    return [*one, np.frombuffer(batch.column(f"{label}_matrix")[row].as_buffer(), f"<i{item}").reshape(len(one[0]), -1)]


def partial_scores(queries: np.ndarray, candidates: np.ndarray, slices: int) -> list[np.ndarray]:
    """Per slice, a matrix of partial scores; whole numbers, in floats or doubles if these are exact, or else in integers."""
    width = max(1, queries.shape[1], candidates.shape[1])
    width += -width % slices
    peak = float(width)
    for x in (queries, candidates):
        peak *= max(float(x.max(initial=0)), -float(x.min(initial=0)))
    if peak >= 2.0**62:
        raise ValueError("scores beyond 2**62")
    kind = np.float32 if peak < 2.0**24 else np.float64 if peak < 2.0**53 else np.int64
    q, c = (np.pad(x.astype(kind), ((0, 0), (0, width - x.shape[1]))) for x in (queries, candidates))
    step = width // slices
    return [q[:, i:i + step] @ c[:, i:i + step].T for i in range(0, width, step)]


def _looked_up(parts: list[np.ndarray], query: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sum(p[query, at].astype(np.int64) for p in parts)


def _highest(scores: np.ndarray, n: int) -> np.ndarray:
    return np.partition(scores, scores.shape[1] - n, axis=1)[:, -n:]


def _phase_one(k: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}  # per query block its numbers, the highest partial scores of each slice and the highest scores so far
        for batch in batches:
            for row in range(batch.num_rows):
                (q_no, q), (c_no, c) = (_held(batch, x, row, "no") for x in "qc")
                parts = partial_scores(q, c, slices)
                many, of = parts[0].shape
                if q_no[0] not in known:
                    known[q_no[0]] = q_no.copy(), *(np.full((many, k + 1), LOWEST) for _ in range(slices + 1))
                held = known[q_no[0]]
                most = min(k + 1, of)
                lists = np.full((many, slices * most), -1)
                for i, p in enumerate(parts):
                    some = np.flatnonzero(p.max(axis=1).astype(np.int64) > held[i + 1].min(axis=1))
                    own = p[some]
                    at = np.argpartition(own, of - most, axis=1)[:, of - most:]
                    lists[some, i * most:(i + 1) * most] = at
                    found = np.take_along_axis(own, at, axis=1).astype(np.int64)
                    held[i + 1][some] = _highest(np.concatenate([held[i + 1][some], found], axis=1), k + 1)
                lists.sort(axis=1)
                fresh = lists >= 0
                fresh[:, 1:] &= lists[:, 1:] != lists[:, :-1]
                query, place = np.nonzero(fresh)
                scores = np.full(lists.shape, LOWEST)
                scores[query, place] = _looked_up(parts, query, lists[query, place])
                held[-1][:] = _highest(np.concatenate([held[-1], scores], axis=1), k + 1)
        for q_no, *_, best in known.values():
            query, place = np.nonzero(best > LOWEST)
            yield pa.RecordBatch.from_arrays([pa.array(q_no[query]), pa.array(best[query, place])], ["q_no", "score"])
    return run


def _phase_two(slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (q_no, cutoff, q), (c_no, c) = _held(batch, "q", row, "no", "cutoff"), _held(batch, "c", row, "no")
                parts = partial_scores(q, c, slices)
                within = 1 << (24 if parts[0].dtype == np.float32 else 53 if parts[0].dtype == np.float64 else 62)
                share = np.clip(-(-cutoff // slices), -within, within).astype(parts[0].dtype)[:, None]
                enough = np.zeros(parts[0].shape, bool)
                for p in parts:
                    enough |= p >= share
                query, at = np.divmod(np.flatnonzero(enough), len(c_no))
                score = _looked_up(parts, query, at)
                keep = score >= cutoff[query]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_no[query[keep]]), pa.array(c_no[at[keep]]), pa.array(score[keep])], ["q_no", "c_no", "score"])
    return run


def _pairs(c: DataFrame, q: DataFrame) -> DataFrame:
    """Every candidate block with every query block. The hint holds whatever the sizes, as a broadcast would send
    blocks through the driver. A task holds some query blocks while the candidate blocks pass."""
    blocks, parts = q.count(), max(1, c.rdd.getNumPartitions())
    tasks = min(TASKS, max(2 * c.sparkSession.sparkContext.defaultParallelism, c.count() * blocks // PAIRS))
    return c.crossJoin(q.repartition(max(1, min(blocks, -(-tasks // parts)))).hint("shuffle_replicate_nl"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, slices: int = 2,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best k rows of ``vectors`` for each row of ``queries``, itself left out: query_id, rank (from
    1), vec_id, score."""
    if k < 1 or slices < 1:
        raise ValueError("k and slices are 1 or more")

    def ready(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("values"))
        fields = StructType([StructField("id", rows.schema["id"].dataType), StructField("values", BinaryType())])
        return rows.where(F.col("id").isNotNull() & F.col("values").isNotNull()).mapInArrow(_whole(scale), fields).distinct()

    # Equal vectors once, with the k + 1 smallest ids; numbered, as the numbers tell them in the blocks.
    ranked = ready(vectors).withColumn("r", F.dense_rank().over(Window.partitionBy("values", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")))
    classes = ranked.where(F.col("r") <= k + 1).groupBy("values").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    classes = session.written(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    asked = session.written(ready(queries), "asked")
    distinct = session.written(asked.select("values").distinct().withColumn("no", F.monotonically_increasing_id()), "distinct")
    c = session.written(_blocks(classes, CANDIDATE_BLOCK, "c", ["no"]), "candidate-blocks")
    q = session.written(_blocks(distinct, QUERY_BLOCK, "q", ["no"]), "query-blocks")

    tops = _pairs(c, q).mapInArrow(_phase_one(k, slices), "q_no long, score long")
    # A class may stand for the query itself, so k + 1 scores of distinct classes are needed for a safe cutoff.
    placed = Window.partitionBy("q_no").orderBy(F.desc("score"))
    cutoffs = tops.withColumn("r", F.row_number().over(placed)).where(F.col("r") <= k + 1).groupBy("q_no").agg(
        F.when(F.count("*") > k, F.min("score")).alias("cutoff"))
    cutoffs = session.written(cutoffs.withColumnRenamed("q_no", "no"), "cutoffs")
    shared = distinct.join(cutoffs, "no", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(LOWEST)))
    q = session.written(_blocks(shared, QUERY_BLOCK, "q", ["no", "cutoff"]), "query-blocks")
    found = _pairs(c, q).mapInArrow(_phase_two(slices), "q_no long, c_no long, score long")
    best = found.withColumn("r", F.rank().over(placed)).where(F.col("r") <= k + 1)
    members = best.join(classes.select(F.col("no").alias("c_no"), "ids"), "c_no").select("q_no", "score", F.explode("ids").alias(key))
    named = asked.join(distinct, "values").select(F.col("no").alias("q_no"), F.col("id").alias("query_id"))
    answers = members.join(named, "q_no").where(F.col("query_id") != F.col(key))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def _trimmed(values: Column) -> Column:
    """Without the zeros at the end, which change no score, so vectors that differ in them alone are equal."""
    last = F.aggregate(F.sequence(F.lit(1), F.size(values)), F.lit(0), lambda at, i: F.when(F.element_at(values, i) != 0, i).otherwise(at))
    return F.when(F.size(values) > 0, F.slice(values, 1, last)).otherwise(values)
