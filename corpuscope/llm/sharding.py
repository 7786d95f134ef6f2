"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Every row lies in a block. How many rows of each block go to each shard is drawn first: the counts of a
uniformly random arrangement follow the multivariate hypergeometric law, and are drawn block by block
from what the shards have left, so that rows and columns of the matrix add up exactly. Then each
block permutes its rows and deals them out by its row of the matrix, the rows are exchanged, and
each shard permutes what it got. Only keys, sizes and checksums move.

The matrix has at most ``MAX_BLOCKS`` rows, so it is bounded; blocks and the ranges inside a shard grow in
number with the rows, so no task gets a whole shard. Rows are numbered once, in a written table, so a lost
executor changes nothing; repeated rows and equal or null keys are rows like any other, and no key
can be hot. The result depends on the seed and on how the input is split into files.

Defined cases: a null text has no bytes; shards stay empty if there are fewer rows than shards; an empty
table gives an empty result; other columns are left out, so no name can clash."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import session

MAX_BLOCKS = 4096
BLOCK_ROWS = 50_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows taken from ``good + bad`` are good."""
    if min(good, bad, sample) == 0 or sample == good + bad:
        return 0 if good == 0 or sample == 0 else good if sample == good + bad else sample
    if good + bad < 10**9:
        return int(draw.hypergeometric(good, bad, sample))
    # Beyond the generator's range: inversion over all values whose chance a double can tell from none.
    share = good / (good + bad)
    mean = sample * share
    reach = int(40 * math.sqrt(mean * (1 - share) + 1)) + 40
    low, high = max(0, sample - bad, int(mean) - reach), min(good, sample, int(mean) + reach)
    steps = np.arange(low, high, dtype=float)
    ratio = np.log(good - steps) + np.log(sample - steps) - np.log(steps + 1) - np.log(bad - sample + steps + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, draw.random() * chances[-1], side="right"))


def matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows per block and shard; its margins are the sizes of the blocks and of the shards."""
    draw = np.random.default_rng(seed)
    left = list(shards)
    counts = np.zeros((len(blocks), len(shards)), np.int64)
    for row, size in enumerate(blocks):
        others = sum(left)
        for shard, room in enumerate(left):
            others -= room
            taken = hypergeometric(draw, room, others, size)
            counts[row, shard] = taken
            size -= taken
        left = [a - int(b) for a, b in zip(left, counts[row], strict=True)]
    return counts


def _part(value: Column, parts: int) -> Column:
    return F.pmod(value, F.lit(parts)).cast("int")


def assign(df: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Key, size (bytes of the text plus 8), text_crc32, shard and slot of each row."""
    if shards < 1:
        raise ValueError("at least one shard")
    spark = df.sparkSession
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = session.written(df.select(
        F.col(key), (F.octet_length(data) + F.lit(8)).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row")), "rows")
    total = rows.count()
    parts = max(1, min(MAX_BLOCKS, -(-total // BLOCK_ROWS)))
    blocked = rows.withColumn("__block", _part(F.xxhash64(F.lit(seed), F.lit("block"), "__row"), parts))
    sizes = {r["__block"]: r["count"] for r in blocked.groupBy("__block").count().collect()}
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    counts = matrix([sizes.get(b, 0) for b in range(parts)], wanted, seed)
    ends = spark.createDataFrame([(b, row) for b, row in enumerate(np.cumsum(counts, axis=1).tolist())],
                                 "__block int, __ends array<bigint>")
    # Permute inside each block and deal out by its row of the matrix.
    local = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "__row"), "__row")
    dealt = blocked.withColumn("__at", F.row_number().over(local) - 1).join(ends, "__block").withColumn(
        "shard", F.size(F.filter("__ends", lambda end: end <= F.col("__at"))))
    # Exchange, and permute inside each shard: ranges of a random order, then the order in each range.
    ranges = max(1, min(MAX_BLOCKS, -(-total // (shards * BLOCK_ROWS))))
    order = F.xxhash64(F.lit(seed), F.lit("slot"), "__row")
    sent = dealt.select(key, "size", "text_crc32", "__row", "shard", order.alias("__order")).withColumn(
        "__range", F.floor((F.shiftrightunsigned("__order", 1) / F.lit(float(1 << 63))) * ranges).cast("int"))
    placed = session.written(sent.withColumn("__inside", F.row_number().over(
        Window.partitionBy("shard", "__range").orderBy("__order", "__row")) - 1), "sent")
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__range").agg(F.count("*").alias("__n")).select(
        "shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, ["shard", "__range"]).select(
        key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__inside")).cast("long").alias("slot"))


def write(df: DataFrame, places: DataFrame, folder: str, key: str = "doc_id", file_rows: int = 100_000) -> None:
    """The rows of ``df`` (unique, non-null keys) as one folder of files per shard, in the order of the slots."""
    at = places.select(key, "shard", "slot")
    joined = df.drop("shard", "slot").join(at, key)
    run = F.floor(F.col("slot") / file_rows)
    joined.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
