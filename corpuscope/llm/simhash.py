"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius.

The terms of a text are its pairs of neighbouring words (and its last word), so that common words alone
don't make texts alike. Each term votes on every bit of the fingerprint, for or against by the bits of
its hash, with a weight: the number of characters of the term, at most ``MAX_WEIGHT``, as longer
words say more. A bit of the fingerprint is set where the votes for it outweigh the others.

All of it is DataFrame operations. The votes of four bits share one long, 16 bits each, so that a sum of
16 longs counts 64 bits; terms are summed per text and run of ``RUN`` terms, which cannot overflow.

Near fingerprints are found with permuted block tables: a fingerprint is cut into ``blocks``, and for each
choice of ``blocks - radius`` of them a table is keyed by their bits. Two fingerprints within the
radius differ in at most ``radius`` blocks, so they agree in all blocks of some choice, and meet in
its table; the distance is then checked. Only distinct fingerprints meet, so copies cost nothing.

Defined cases: a null text counts as empty, and an empty text has no votes: fingerprint 0; words are
runs of anything but ASCII white space, A-Z lower-cased; repeated rows stay; other columns are left
out, so no name can clash; an empty table gives an empty result. In the order of ids, null ids come last
and rows with equal ids by their text; after the last row comes the first."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import session
from corpuscope.llm import common

HALVES = 2          # longs of 64 bits in a fingerprint
MAX_WEIGHT = 15
RUN = 32_767 // MAX_WEIGHT  # so that the highest lane leaves the sign of its long alone
LANES = (1 << 48) | (1 << 32) | (1 << 16) | 1
MAX_BUCKETS = 10_000
BUCKET_ROWS = 20_000


def terms(text: Column) -> Column:
    """(hashes, weight) of each term of a text."""
    own = common.words(common.lower_ascii(text))
    return F.zip_with(own, F.slice(own, 2, 2_000_000_000), lambda a, b: F.struct(
        *[F.xxhash64(F.lit(seed), a, b).alias(f"h{seed}") for seed in range(HALVES)],
        F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(MAX_WEIGHT)).cast("long").alias("weight")))


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys (unique) and ``bits``: the fingerprint's longs, of each row."""
    lanes = [F.sum(F.shiftrightunsigned(F.col(f"__t.h{half}"), shift).bitwiseAND(F.lit(LANES)) * F.col("__t.weight")).alias(f"__s{half}_{shift}")
             for half in range(HALVES) for shift in range(16)]
    # A lane holds at most RUN * MAX_WEIGHT, below 2**15. Bit ``shift + 16 * lane`` is in lane ``lane``.
    counts = {f"__c{half}_{bit}": F.shiftrightunsigned(F.col(f"__s{half}_{bit % 16}"), bit // 16 * 16).bitwiseAND(F.lit(0xFFFF))
              for half in range(HALVES) for bit in range(64)}

    def counted(some: DataFrame, run: list[Column]) -> DataFrame:
        each = some.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("__at", "__t"))
        sums = each.groupBy(*keys, *run).agg(F.sum("__t.weight").alias("__weight"), *lanes)
        return sums.select(*keys, "__weight", *[c.alias(name) for name, c in counts.items()])

    # Words are parted by white space, so a text of fewer than 2 * RUN bytes is one run, and its lanes are its counts. The runs of
    # longer ones are summed once more. The bytes tell before any term is made, so no text has its terms made twice.
    short = F.coalesce(F.octet_length(text), F.lit(0)) < 2 * RUN
    one = counted(rows.where(short), [])
    several = counted(rows.where(~short), [F.coalesce(F.floor(F.col("__at") / RUN), F.lit(0)).alias("__run")])
    totals = one.unionByName(several.groupBy(*keys).agg(F.sum("__weight").alias("__weight"), *[F.sum(name).alias(name) for name in counts]))
    longs = [reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(2 * F.col(f"__c{half}_{bit}") > F.col("__weight"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0))
        for bit in range(64)]).cast("long") for half in range(HALVES)]
    return totals.select(*keys, F.array(*longs).alias("bits"))


def as_text(bits: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(bits[half])), 16, "0") for half in range(HALVES)])


def distance(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[half].bitwiseXOR(b[half])) for half in range(HALVES)])


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(a, b) / F.lit(float(64 * HALVES))


def with_next(df: DataFrame, order: list[str], columns: dict[str, str]) -> DataFrame:
    """The rows and, under new names, columns of the next row by ``order`` (a number first, nulls last);
    after the last comes the first.

    Rows are dealt to ranges of the first order column, cut at quantiles and evenly between them, and
    each range also gets the first row of the next one. The starts of the ranges are at most
    ``MAX_BUCKETS`` rows, so the join with them is bounded."""
    key = F.col(order[0]).cast("double")
    slim = df.select(key.alias("k"))
    facts = slim.agg(F.count("*").alias("n"), F.percentile_approx("k", [i / 100 for i in range(101)], 10_000).alias("cuts")).first()
    points = sorted(set(facts["cuts"] or []))
    inner = max(1, min(MAX_BUCKETS // 101, -(-facts["n"] // (BUCKET_ROWS * 100))))
    if facts["n"] <= BUCKET_ROWS or len(points) < 2:
        bucket = F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    else:
        at = F.array(*[F.lit(float(p)) for p in points])
        place = F.greatest(F.size(F.filter(at, lambda p: p <= key)), F.lit(1))
        low, high = at[place - 1], F.coalesce(F.try_element_at(at, place + 1), F.element_at(at, -1) + 1)
        share = F.least(F.greatest((key - low) / (high - low), F.lit(0.0)), F.lit(0.999999))
        bucket = F.when(key.isNull(), F.lit(len(points) * inner + inner)).otherwise((place * inner + F.floor(share * inner)).cast("int"))
    marked = df.withColumn("__bucket", bucket.cast("int"))
    starts = marked.groupBy("__bucket").agg(F.min(order[0]).alias("__first")).orderBy("__bucket").collect()  # at most MAX_BUCKETS
    if not starts:
        return df.select("*", *[df[c].alias(name) for c, name in columns.items()])
    buckets = [r["__bucket"] for r in starts]
    before = df.sparkSession.createDataFrame([(r["__bucket"], r["__first"], buckets[i - 1]) for i, r in enumerate(starts)],
                                             f"__of int, __first {df.schema[order[0]].dataType.simpleString()}, __to int")
    # At most MAX_BUCKETS slim rows are broadcast, so the rows with texts stay where they are.
    halo = marked.join(F.broadcast(before), (F.col("__bucket") == F.col("__of")) & F.col(order[0]).eqNullSafe(F.col("__first"))).select(
        *df.columns, F.col("__to").alias("__bucket"), F.lit(1).alias("__halo"))
    both = marked.withColumn("__halo", F.lit(0)).unionByName(halo)
    w = Window.partitionBy("__bucket").orderBy("__halo", *[F.col(c).asc_nulls_last() for c in order])
    shown = both.withColumns({name: F.lead(c).over(w) for c, name in columns.items()})
    return shown.where("__halo = 0").drop("__bucket", "__halo")


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, fingerprint (hexadecimal) and bits (longs) of each row."""
    rows = df.select(F.col(key), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    return votes(rows, [key, "__row"], "__text").select(key, as_text(F.col("bits")).alias("fingerprint"), "bits")


def edited(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, text, and the text whose last quarter (rounded down, in code points) is replaced by as much
    of the beginning of the next row's text, or all of that."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shown = with_next(rows, [key, "text"], {"text": "__next"})
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    return shown.select(key, "text", n.alias("n_chars"), F.concat(
        F.substring("text", F.lit(1), n.cast("int") - cut), F.substring("__next", F.lit(1), cut)).alias("edited"))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs of distinct fingerprints (``low`` < ``high``, as hexadecimal) within the radius, and their distance.

    ``prints`` has ``fingerprint`` and ``bits``, with repeats; members of a pair are found again by joining
    on the fingerprint."""
    if not 0 <= radius < blocks or (64 * HALVES) % 8:
        raise ValueError("blocks must exceed the radius")
    total = 64 * HALVES
    cuts = [total * b // blocks for b in range(blocks + 1)]
    digits = F.concat(*[F.lpad(F.bin(F.col("bits")[half]), 64, "0") for half in range(HALVES)])
    distinct = session.written(prints.groupBy("fingerprint").agg(F.first("bits").alias("bits")), "prints")
    choices = list(combinations(range(blocks), blocks - radius))
    cut = [F.substring(digits, cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in range(blocks)]
    tables = F.array(*[F.xxhash64(F.lit(no), *[cut[b] for b in choice]) for no, choice in enumerate(choices)])
    keyed = distinct.select("fingerprint", "bits", F.posexplode(tables).alias("table", "block_key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col("a.table") == F.col("b.table"), F.col("a.block_key") == F.col("b.block_key"),
            F.col("a.fingerprint") < F.col("b.fingerprint"), distance(F.col("a.bits"), F.col("b.bits")) <= radius]
    return a.join(b, reduce(and_, same)).select(
        F.col("a.fingerprint").alias("low"), F.col("b.fingerprint").alias("high"),
        distance(F.col("a.bits"), F.col("b.bits")).alias("distance")).distinct()
