"""Hard negatives of anchors, exactly: threshold joins after L2AP, with thresholds that fall until windows are filled.

An anchor's positives are its best other rows of the same label; the window of a positive reaches from ``low`` times
its score up to its score, and its negatives are the best rows of other labels inside. Scores are inner products of
components rounded down to whole numbers (``floor(scale * x)``), so they are exact integers.

Anchors and rows travel as blocks, and each pair of blocks is work of its own: the pairs with a score at or above the
anchor's threshold.

* Index. Dimensions are ordered by their share of all squares. A row's last dimensions are left out of the inverted index as
  far as the norm of what is left out, times that of the same dimensions of any anchor of the block, stays
  below the threshold: a pair that meets nowhere in the index cannot reach it. The posting list of a
  dimension is the rows it is indexed for, and all of them at once add to the partial scores.
* Prune. Partial score plus the product of the norms of the remaining dimensions bounds the score; pairs below
  the threshold go, first where the index ends, then after every few dimensions of what was left out.
* Lower. Thresholds start high, so the first rounds index few dimensions and return few rows. An anchor whose windows are not
  filled comes again with a lower threshold, and only scores below the last one are returned. A positive with a negative score has an
  empty window, so 0 is the last threshold for positives; the lower end of the windows is that for negatives.

A block returns no more rows per anchor (and window) than are asked for, so what is gathered doesn't grow with rows beyond that.
Rows with equal vector and label are one class with its smallest ids, enough for every answer; equal anchors of one label are searched
once. So copies, however many, are compared and shipped once.

Defined cases: rows with a null id, label or vector, or a vector that holds a null, NaN or infinite component, take no
part; of the others with one id, the row with the smallest label, then vector, stands for all; ties go to the smaller id; shorter vectors count as filled up with zeros; labels are whole numbers; other columns are left out, so no name
can clash; an empty table gives an empty result. Components beyond 2**53 / scale are refused, as are scores beyond 2**53."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import session
from corpuscope.llm.topk import _dense, _trimmed, whole

ANCHORS, ROWS = 256, 4096   # of a block
STEP = 8                    # dimensions added between two tests
START = 0.9                 # first threshold, of the largest possible score
FALL, SLOWER = 0.65, 0.85   # next threshold, of the last, if it found nothing or too little
HIGH = 1 << 62


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """For each row and place, the norm of the components from there on, no less than it is."""
    squares = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
    return np.concatenate([np.sqrt(squares), np.zeros((len(rows), 1))], axis=1) * (1 + 1e-12)


def threshold_join(anchors: np.ndarray, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, row, score) of every pair with a score of at least ``least[anchor]``, and the number of products formed."""
    dims = anchors.shape[1]
    norms, row_norms = suffix_norms(anchors), suffix_norms(rows)
    # How many dimensions of a row the index needs; whole numbers are exact, so half a unit is slack enough for roundings.
    floor = least - 0.5
    share = np.full(norms.shape, np.inf)
    np.divide(norms, floor[:, None], out=share, where=(floor > 0)[:, None])
    ratio = share.max(axis=0, initial=0.0)
    endless = np.isinf(ratio)  # a threshold of 0 or less: every pair may reach it
    needed = endless | (np.where(endless, 0.0, ratio) * row_norms >= 1)
    depth = np.minimum(-(-needed[:, :dims].sum(axis=1) // STEP) * STEP, dims)
    order = np.argsort(-depth, kind="stable")
    depth, held, held_norms = depth[order], rows[order], row_norms[order]
    partial = np.zeros((len(anchors), len(rows)))
    work = 0
    for at in range(0, int(depth.max(initial=0)), STEP):
        listed = np.searchsorted(-depth, -at, side="left")  # rows indexed beyond ``at``
        partial[:, :listed] += anchors[:, at:at + STEP] @ held[:listed, at:at + STEP].T
        work += len(anchors) * int(listed) * min(STEP, dims - at)
    found = []
    for end in np.unique(depth[depth > 0]):
        first, past = np.searchsorted(-depth, [-end, -end + 1])
        bound = partial[:, first:past] + norms[:, end:end + 1] * held_norms[first:past, end]
        one, two = np.nonzero(bound >= floor[:, None])
        two = two + first
        score = partial[one, two]
        for at in range(int(end), dims, STEP):
            work += len(one) * min(STEP, dims - at)
            score = score + np.einsum("ij,ij->i", anchors[one, at:at + STEP], held[two, at:at + STEP])
            stay = score + norms[one, min(at + STEP, dims)] * held_norms[two, min(at + STEP, dims)] >= floor[one]
            one, two, score = one[stay], two[stay], score[stay]
        found.append((one, order[two], score))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none.astype(float), work
    one, two, score = (np.concatenate(x) for x in zip(*found, strict=True))
    stay = score >= least[one]
    return one[stay], two[stay], score[stay], work


def _best(anchor: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each anchor."""
    order = np.lexsort((tie, -score, anchor))
    sorted_anchor = anchor[order]
    start = np.searchsorted(sorted_anchor, sorted_anchor, side="left")
    return order[np.arange(len(order)) - start < k]


def _list(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _matrices(one: pa.RecordBatch, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [_dense(one.column(f"{side}_values"), 1) for side in "qc"]
    width = len(order)
    found = [np.pad(m, ((0, 0), (0, width - m.shape[1])))[:, order] for m in found]
    if float(np.abs(found[0]).max(initial=0)) * float(np.abs(found[1]).max(initial=0)) * width >= 2.0**53:
        raise ValueError("scores beyond 2**53")
    return found[0], found[1]


def _search(order: np.ndarray, same: bool, k: int, low: Fraction):
    """For each pair of blocks, the best classes of each anchor (same label) or of each of its windows (other labels)."""
    def groups(q_label: np.ndarray, c_label: np.ndarray):
        if same:
            for label in np.unique(q_label):
                yield np.flatnonzero(q_label == label), np.flatnonzero(c_label == label)
        else:
            every = np.arange(len(c_label))
            for at in range(0, len(q_label), 64):
                yield np.arange(at, min(at + 64, len(q_label))), every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                one = batch.slice(place, 1)
                anchors, rows = _matrices(one, order)
                q_no, q_label, least, past = (_list(one, f"q_{x}") for x in ("no", "label", "least", "past"))
                c_no, c_label, c_first = (_list(one, f"c_{x}") for x in ("no", "label", "first"))
                tops = one.column("q_tops").flatten()
                for own, other in groups(q_label, c_label):
                    a, b, score, _ = threshold_join(anchors[own], rows[other], least[own])
                    a, b, score = own[a], other[b], score.astype(np.int64)
                    stay = (score < past[a]) & ((q_label[a] == c_label[b]) == same)
                    a, b, score = a[stay], b[stay], score[stay]
                    kept = _best(a, score, c_first[b], k) if same else _of_windows(a, score, c_first[b], tops, k, low)
                    yield pa.RecordBatch.from_arrays([pa.array(q_no[a[kept]]), pa.array(c_no[b[kept]]), pa.array(score[kept])], ["a", "c", "score"])
    return run


def _of_windows(anchor: np.ndarray, score: np.ndarray, tie: np.ndarray, tops: pa.ListArray, k: int, low: Fraction) -> np.ndarray:
    sizes = np.diff(np.asarray(tops.offsets))
    flat = tops.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    kept = [np.empty(0, np.int64)]
    for nth in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes[anchor] > nth)
        top = flat[first[anchor[has]] + nth]
        inside = has[(score[has] <= top) & (score[has] * low.denominator >= top * low.numerator)]
        kept.append(inside[_best(anchor[inside], score[inside], tie[inside], k)])
    return np.unique(np.concatenate(kept))


def _ready(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), whole(F.col(vector), scale).alias("values"))
    whole_rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("values").isNotNull())
    one = F.min(F.struct("label", _trimmed(F.col("values")).alias("values"))).alias("row")
    return whole_rows.groupBy("id").agg(one).select("id", "row.label", "row.values")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Rows of equal vector and label as one, with the k smallest ids; taken in parts first, as a class may hold most rows."""
    part = Window.partitionBy("values", "label", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k)
    return few.groupBy("values", "label").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids")).withColumn(
        "no", F.monotonically_increasing_id())


def _blocks(rows: DataFrame, columns: list[str], size: int, side: str) -> DataFrame:
    number = F.pmod(F.xxhash64("no"), F.lit(size)).cast("int").alias(side)
    return rows.groupBy(number).agg(F.collect_list(F.struct(*columns)).alias("held")).select(
        side, *[F.col("held")[c].alias(f"{side}_{c}") for c in columns])


class _Search:
    """The classes of the rows, in blocks, and how anchors meet them."""

    def __init__(self, rows: DataFrame, k: int, low: Fraction):
        self.k, self.low = k, low
        self.classes = session.written(_classes(rows, k + 1), "classes")
        self.size = max(1, -(-self.classes.count() // ROWS))
        blocks = _blocks(self.classes.withColumn("first", F.get("ids", F.lit(0))), ["no", "label", "first", "values"], self.size, "c")
        self.blocks = session.written(blocks, "row-blocks")
        shares = self.classes.select(F.posexplode("values").alias("dim", "x")).groupBy("dim").agg(
            F.sum(F.col("x").cast("double") * F.col("x")).alias("share")).collect()  # as many rows as dimensions
        self.squares = {row.dim: row.share for row in shares}
        largest = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        self.norm = float(self.classes.agg(F.coalesce(F.max(F.sqrt(largest)), F.lit(0.0))).first()[0])

    def round(self, active: DataFrame, width: int, same: bool) -> DataFrame:
        """a, id, score of the rows that blocks return for active anchors (no, label, values, least, past, tops)."""
        dims = max([width, 1, *(d + 1 for d in self.squares)])
        order = np.argsort([-self.squares.get(d, 0.0) for d in range(dims)], kind="stable")
        count = max(1, -(-active.count() // ANCHORS))
        blocks = _blocks(active, ["no", "label", "least", "past", "tops", "values"], count, "q")
        copies = blocks.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(self.size - 1))))
        pairs = copies.repartition(self.size, "c").join(self.blocks.repartition(self.size, "c").hint("merge"), "c").drop("q", "c")
        found = pairs.mapInArrow(_search(order, same, self.k + same, self.low), "a long, c long, score long")
        members = found.join(self.classes.select(F.col("no").alias("c"), F.explode("ids").alias("id")), "c")
        return session.written(members.select("a", "id", "score"), "found")


def _start(values: Column, norm: float) -> Column:
    """The largest score that the anchor can have."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) * F.lit(norm)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: Fraction = Fraction(4, 5),
         scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each row of ``anchors``, each of its best ``positives`` rows of its label in ``vectors``, and each of the best
    ``negatives`` rows of other labels with a score from ``low`` times the positive's up to the positive's: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    low = Fraction(low)
    if positives < 1 or negatives < 1 or not 0 < low <= 1:
        raise ValueError("positives and negatives are 1 or more, low is above 0 and at most 1")
    search = _Search(_ready(vectors, key, vector, label, scale), max(positives, negatives), low)
    asked = _ready(anchors, key, vector, label, scale)
    classes = session.written(asked.groupBy("values", "label").agg(F.min("id").alias("x")).drop("x").withColumn(
        "no", F.monotonically_increasing_id()), "asked")
    named = session.written(asked.join(classes, ["values", "label"]).select(F.col("no").alias("a"), F.col("id").alias("anchor_id")), "named")
    width = classes.agg(F.coalesce(F.max(F.size("values")), F.lit(0))).first()[0]
    limit = F.lit(HIGH)
    # Positives; one more than asked for, as an anchor may be its own best.
    active = session.written(classes.withColumns({
        "peak": _start(F.col("values"), search.norm), "past": limit, "tops": F.array().cast("array<bigint>")}).withColumn(
        "least", F.floor(F.col("peak") * START).cast("long")), "active")
    found = None
    while not active.isEmpty():
        here = search.round(active, width, True)
        found = here if found is None else found.unionByName(here)
        have = found.groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "no")
        after = active.join(have, "no", "left").where((F.coalesce("n", F.lit(0)) <= positives) & (F.col("least") > 0))
        fallen = F.floor(F.col("least") * F.when(F.col("n") > 0, SLOWER).otherwise(FALL)).cast("long")
        active = session.written(after.withColumns({
            "past": F.col("least"), "least": F.when(fallen < F.col("peak") * 0.05, 0).otherwise(fallen)}).drop("n"), "active")
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a long, id long, score long")
    order = Window.partitionBy("anchor_id", "a").orderBy(F.desc("score"), "id")
    own = found.where("score >= 0").distinct().join(named, "a").where("id <> anchor_id")
    best = session.written(own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives).drop("r"), "positives")
    # Negatives of the windows that any anchor of a class has.
    windows = best.select("a", F.col("score").alias("top")).distinct()
    windows = session.written(windows.withColumn("end", F.ceil(F.col("top") * low.numerator / F.lit(low.denominator).cast("double") - 1e-9)), "windows")
    tops = windows.groupBy("a").agg(F.array_sort(F.collect_list("top")).alias("tops"), F.min("end").alias("end"), F.max("top").alias("high"),
                                    F.min("top").alias("low")).withColumnRenamed("a", "no")
    active = session.written(classes.join(tops, "no").withColumns({
        "past": F.col("high") + 1, "least": F.greatest("end", F.floor(F.col("low") * 0.95))}), "active")
    hard = None
    while not active.isEmpty():
        here = search.round(active, width, False)
        hard = here if hard is None else hard.unionByName(here)
        counted = windows.join(hard, "a").where("score BETWEEN end AND top").groupBy("a", "top").agg(F.countDistinct("id").alias("n"))
        short = windows.join(counted, ["a", "top"], "left").where(F.coalesce("n", F.lit(0)) < negatives).groupBy(F.col("a").alias("no")).agg(
            F.min("end").alias("wanted"))
        after = active.join(short, "no").where(F.col("least") > F.col("wanted"))
        active = session.written(after.withColumns({
            "past": F.col("least"), "least": F.greatest("wanted", F.floor(F.col("least") * SLOWER))}).drop("wanted"), "active")
    if hard is None:
        hard = vectors.sparkSession.createDataFrame([], "a long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("a", "top").orderBy(F.desc("score"), "id"))
    inside = windows.join(hard.distinct(), "a").where(_inside(low)).withColumn("rank", rank).where(F.col("rank") <= negatives)
    return best.withColumnsRenamed({"id": "positive_id", "score": "top"}).join(
        inside.select("a", "top", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["a", "top"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score")


def _inside(low: Fraction) -> Column:
    return (F.col("score") <= F.col("top")) & (F.col("score") * low.denominator >= F.col("top") * low.numerator)
