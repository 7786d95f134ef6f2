"""Benchmark passages in documents, exactly: winnowing.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words is one window of its own
length. Of the k-grams of a window (k: the largest power of two up to half its words, rounded up) the smallest hash is its
fingerprint, so equal windows have equal fingerprints, and neighbouring windows mostly share theirs: of 10 words and
4-grams, a text has about one fingerprint per 4 words.

1. Prints: the distinct fingerprints of a text, in blocks of ``BLOCK`` windows, written once as a slim table.
2. Join: fingerprints of texts with those of the items. Every occurrence of a window is in a block that meets
   its fingerprint, so none is missed.
3. Extension: only in such blocks, and only windows with such a fingerprint, are compared word by word.
   Texts meet the matches by one shuffle at every size.

One pass of prints per length that items have (``window``, and any shorter ones). A result belongs to a text,
known by 128 bits of hashes, so copies of it share one.

A word is a run of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. Defined cases: null, empty
and wordless texts have no words, no hits, and occur nowhere as items; items without an id mark words but name no
item; rows with the same item id are one item; repeated and equal rows of documents each get their row; keys may
be of any type and null; no other column is read, so no name can clash; an empty table on either side gives
no hits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import session
from corpuscope.functions.text import let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 1024  # windows of one block of prints
SPANS = "array<struct<start: int, end: int>>"


def words(text: Column) -> Column:
    """The words of a text; ``lower`` is enough, and faster, where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def _identity(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _over(values: Column, width: int, merge: Callable[[Column, Column], Column]) -> Column:
    """At each place, ``merge`` over the ``width`` values from there, by doubling. Overlaps do no harm: equal runs of values
    are merged alike. The last places, where fewer values are left, mean nothing."""
    def step(shift: int) -> Callable[[Column], Column]:
        return lambda v: F.transform(v, lambda x, i: merge(x, F.get(v, i + shift)))

    covered = 1
    while covered < width:
        shift = min(covered, width - covered)
        values = let(values, step(shift))
        covered += shift
    return values


def minima(pieces: Column, length: int) -> Column:
    """The fingerprint of every window of ``length`` words, in order."""
    k = 1 << (-(-length // 2)).bit_length() - 1
    count = F.size(pieces)
    hashed = F.transform(pieces, lambda w: F.xxhash64(F.lit(length), w))
    lowest = _over(_over(hashed, k, lambda x, y: F.xxhash64(x, y)), length - k + 1, lambda x, y: F.least(x, y))
    return F.when(count >= length, F.slice(lowest, F.lit(1), count - (length - 1))).otherwise(F.array().cast("array<bigint>"))


def _block_prints(lowest: Column) -> Column:
    """array<struct(block, print)>: the distinct fingerprints of each block of windows."""
    last = F.greatest(F.floor((F.size(lowest) - 1) / F.lit(BLOCK)), F.lit(0)).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda b: F.transform(
        F.array_distinct(F.slice(lowest, b * BLOCK + 1, F.lit(BLOCK))), lambda p: F.struct(b.alias("block"), p.alias("print")))))


def _met_windows(pieces: Column, blocks: Column, length: int) -> Column:
    """array<struct(start, end, passage)>: the windows whose fingerprint the items have, in the blocks where one was met."""
    def spell(start: Column) -> Column:
        return F.struct(start.alias("start"), (start + length).alias("end"),
                        F.array_join(F.slice(pieces, start + 1, F.lit(length)), " ").alias("passage"))

    def of_block(lowest: Column):
        def run(block: Column) -> Column:
            first = block["block"] * BLOCK
            past = F.least(F.size(lowest), first + BLOCK)
            places = F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(F.filter(places, lambda s: F.array_contains(block["prints"], F.get(lowest, s))), spell)
        return run

    return let(minima(pieces, length), lambda lowest: F.flatten(F.transform(blocks, of_block(lowest))))


def item_windows(items: DataFrame, window: int, text: str = "text", key: str = "item_id") -> DataFrame:
    """item, length, passage (its words joined by blanks), print: the distinct windows of the items."""
    split = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    split = session.written(split, "items")
    found = None
    for length in range(1, window + 1):
        own = split.where(F.size("words") >= length if length == window else F.size("words") == length)
        each = own.select("item", F.explode(F.arrays_zip(
            F.transform(F.sequence(F.lit(1), F.size("words") - (length - 1)), lambda i: F.array_join(F.slice("words", i, F.lit(length)), " ")).alias("passage"),
            minima(F.col("words"), length).alias("print"))).alias("w")).select("item", F.lit(length).alias("length"), "w.passage", "w.print")
        found = each if found is None else found.unionByName(each)
    return session.written(found.distinct(), "windows")


def hits(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id",
         item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """For each row of ``docs``: its key, n_words, the ``spans`` of words [start, end) that occurrences of windows cover (joined
    where they overlap or touch), and the ``items`` (ids as strings, sorted) that have an occurring window."""
    found, texts = _found(docs, items, window, text, key, item_text, item_key)
    none = F.array()
    return texts.join(found, ["t1", "t2"], "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("spans", none.cast(SPANS)).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", key: str = "doc_id",
          item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    found = _found(docs, items, window, text, key, item_text, item_key)[0].select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    one, two = _identity(F.col(text))
    marked = docs.withColumns({"__t1": one, "__t2": two})
    return marked.join(session.written(found, "hit").hint("merge"), ["__t1", "__t2"], "left_anti").drop("__t1", "__t2")


def _found(docs: DataFrame, items: DataFrame, window: int, text: str, key: str, item_text: str, item_key: str) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, spans, items of the texts with hits; key, t1, t2, n_words, prints of all rows)."""
    if window < 1:
        raise ValueError("a window has a word or more")
    wanted = item_windows(items, window, item_text, item_key)
    lengths = sorted(row.length for row in wanted.select("length").distinct().collect())
    named = docs.select(F.col(key).alias("key"), *_identity(F.col(text)), F.col(text).alias("text"))
    pieces = words(F.col("text")).alias("words")
    # 1. Prints of all texts.
    own = [_block_prints(minima(F.col("words"), length)) for length in lengths]
    prints = F.concat(*own) if own else F.array().cast("array<struct<block: int, print: bigint>>")
    texts = session.written(named.select("key", "t1", "t2", pieces).select("key", "t1", "t2", F.size("words").cast("long").alias("n_words"), prints.alias("prints")), "prints")
    # 2. Those that items have, by text and block.
    each = texts.select("t1", "t2", F.inline("prints"))
    met = each.join(wanted.select("print").distinct(), "print", "left_semi")
    blocks = met.groupBy("t1", "t2", "block").agg(F.collect_set("print").alias("prints"))
    matched = blocks.groupBy("t1", "t2").agg(F.collect_list(F.struct("block", "prints")).alias("blocks"))
    # 3. Windows, word by word.
    again = named.select("t1", "t2", "text").join(session.written(matched, "matched").hint("merge"), ["t1", "t2"]).select(
        "t1", "t2", "blocks", pieces)
    spelled = [_met_windows(F.col("words"), F.col("blocks"), length) for length in lengths]
    spelled = F.concat(*spelled) if spelled else F.array().cast("array<struct<start: int, end: int, passage: string>>")
    passages = wanted.select("passage").distinct().withColumn("no", F.monotonically_increasing_id())
    passages = session.written(passages, "passages")
    spots = again.select("t1", "t2", F.inline(spelled)).join(passages, "passage").select("t1", "t2", "start", "end", "no")
    spots = session.written(spots.distinct(), "spots")
    owners = wanted.where(F.col("item").isNotNull()).join(passages, "passage").select("no", "item")
    items_of = spots.select("t1", "t2", "no").distinct().join(owners, "no").select("t1", "t2", "item").distinct().groupBy("t1", "t2").agg(
        F.array_sort(F.collect_list("item")).alias("items"))
    found = spans(spots, ["t1", "t2"]).join(items_of, ["t1", "t2"], "left")
    return session.written(found, "found"), texts


def spans(spots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges [start, end) of a text joined where they overlap or touch, in order."""
    ordered = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = spots.select(*by, "start", "end", F.coalesce(F.col("start") > before, F.lit(True)).cast("int").alias("opens"))
    runs = opens.withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).cast(SPANS).alias("spans"))
