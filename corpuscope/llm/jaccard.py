"""Documents linked by the Jaccard similarity of their sets of word n-grams, exactly: a grouped prefix join.

1. Documents with equal sets are one *class*; only classes are compared.
2. Classes that can have a partner at all. Two linked sets differ in at most D elements, with D from their
   sizes. Elements are dealt to m > D parts by their hash, so a linked pair agrees in m - D whole
   parts: a class that shares fewer parts with other classes of a fitting size has no link. Most classes end
   here, also those that share a passage with many others, at the price of one row per part, and no frequent n-gram
   gathers rows, since a whole part has to agree.
3. Prefixes. The n-grams of the remaining classes are counted and ordered from the rarest, and linked
   sets share one in their prefixes. What one class alone has cannot be shared and is left out of its prefix.
   Classes with the same prefix and size are one *group*.
4. Group pairs that share a prefix element, taken at the first they share, and that fit: what stands before that element
   in one set is not in the other, so both places together may not exceed the D of the two sizes. First each list of groups is compared with the first
   of its classes only (a star), which joins the copies of one text without all their pairs; a list whose groups are in
   one component is done. Of what is left, in different components, the members of the smaller side are measured against the
   other group's first class, and what is linked so becomes one component; members of components that still differ
   are expanded only where both are about as far from that first class, and where a histogram of their elements allows
   a link. Two groups meet at all only where the parities of a class of each (512 cells) allow a link of members. So texts near a
   large group, but not linked with it, are not verified against all of its members; only their parities are compared.

Every link decides over the components, though links inside a component are not all written down. Sets are
compared as 64-bit hashes of n-grams; equal sets by 128 bits.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer than ``n`` words is one n-gram.
Defined cases: null, empty and wordless texts have empty sets and are linked with nothing; rows without
id come after all others, and a component of nothing else has a null id; repeated rows are linked, as
their sets are equal, unless empty; other columns are left out, so no name can clash; an empty table gives an empty
result."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import session
from corpuscope.llm import common, graph, windows as w
from corpuscope.llm.substring import LAST, _digest, _id, word_hashes


def sets(lists: pa.ListArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct n-grams of each row of words, in ascending order."""
    offsets, symbols = word_hashes(lists)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    rows = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    grams = w.Hashes(symbols).of(starts, np.minimum(sizes, n)[rows]) if len(rows) else np.empty(0, np.uint64)
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    fresh = np.append(True, (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])) if len(rows) else np.empty(0, bool)
    return np.concatenate([[0], np.cumsum(np.bincount(rows[fresh], minlength=len(sizes)))]), grams[fresh]


def _sums(values: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint64)
    np.add.at(out, keys, values)
    return out


def digests(offsets: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return tuple(w.mixed(_sums(w.mixed(grams * np.uint64(odd)), rows, len(offsets) - 1) + np.diff(offsets).astype(np.uint64))
                 for odd in (0xD1342543DE82EF95, 0x2545F4914F6CDD1D))


def size_classes(largest: int, threshold: Fraction) -> list[int]:
    """Lower bounds of classes of sizes, such that linked sets are in the same class or in neighbours."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(int(bounds[-1] / threshold) + 1)
    return [*bounds, int(bounds[-1] / threshold) + 1]


def parts(offsets: np.ndarray, grams: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the parts of each set."""
    return ruled_parts(offsets, grams, threshold)[:2]


def ruled_parts(offsets: np.ndarray, grams: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, rule): the parts of each set, for the class of its size and, as the smaller of a pair, the next.

    In class c, with sizes up to H, D = floor(2 H (1 - t) / (1 + t)) and m > D parts. At least m - D parts of a linked
    pair agree. Empty parts need no signature in a set that has fewer of them than that; then m - D less the empty ones agree
    among the others. ``rule`` is twice the number that has to agree, and 1 more for the next class."""
    sizes = np.diff(offsets)
    bounds = np.array(size_classes(int(sizes.max(initial=1)), threshold))
    own = np.searchsorted(bounds, sizes, side="right") - 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    found = []
    for ahead in (0, 1):
        at = np.maximum(own, 0) + ahead
        differ = np.array([int(2 * (int(b) - 1) * (1 - threshold) / (1 + threshold)) for b in bounds[1:]] + [0])[at]
        m = differ + 1 + -(-(differ + 1) // 10)
        m = np.where(sizes > 0, m, 0)
        base = np.cumsum(m) - m
        salt = w.mixed((at + 1).astype(np.uint64))
        part = (w.mixed(grams ^ salt[rows]) % m[rows].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        keys = base[rows] + part
        filled = np.bincount(keys, minlength=total).astype(np.int64) > 0
        of = np.repeat(np.arange(len(sizes)), m)
        empty = np.bincount(of[~filled], minlength=len(sizes))
        every = empty > m - differ - 1
        wanted = filled | every[of]
        place = np.arange(total) - base[of]
        signature = w.mixed(_sums(w.mixed(grams), keys, total) + salt[of] * (place + 1).astype(np.uint64))
        needed = np.where(every, m - differ, m - differ - empty)
        found.append((of[wanted], signature[wanted], 2 * needed[of[wanted]] + ahead))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _classes(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, grams = sets(batch.column("words"), n)
            one, two = digests(offsets, grams)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(np.diff(offsets)), _signed(one), _signed(two)],
                                             ["id", "digest", "size", "d1", "d2"])

    return docs.mapInArrow(run, "id long, digest long, size long, d1 long, d2 long")


SEEN = 1_000_000  # classes that a task remembers


def _signatures(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """The parts of each class, once per task (or a few times, if it has more than ``SEEN`` classes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            offsets, grams = sets(batch.column("words"), n)
            d1 = digests(offsets, grams)[0]
            fresh = []
            for row, value in enumerate(d1.tolist()):
                if value not in seen:
                    seen.add(value)
                    fresh.append(row)
            if len(seen) > SEEN:
                seen.clear()
            sizes = np.diff(offsets)
            d1, own = d1[fresh], np.zeros(len(sizes), bool)
            own[fresh] = True
            grams, offsets = grams[np.repeat(own, sizes)], np.concatenate([[0], np.cumsum(sizes[fresh])])
            rows, signature, rule = ruled_parts(offsets, grams, threshold)
            yield pa.RecordBatch.from_arrays([_signed(d1[rows]), pa.array(rule, pa.int32()), _signed(signature)], ["d1", "rule", "part"])

    return docs.select("words").mapInArrow(run, "d1 long, rule int, part long")


CELLS = 64


def histograms(offsets: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How many elements of each set fall into each of ``CELLS`` cells by their hash. Two sets differ in no fewer elements than
    their histograms do."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cell = (w.mixed(grams) >> np.uint64(58)).astype(np.int64)
    return np.bincount(rows * CELLS + cell, minlength=(len(offsets) - 1) * CELLS).astype(np.int32)


def _differ(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x)


MARKS = 8  # longs


def parities(offsets: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """``MARKS`` longs of each set, a bit per cell of the hashes: whether it holds an odd number of elements. Each element that two
    sets differ in changes one bit, so as many bits differ at most."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bits = MARKS * 64
    cell = (w.mixed(grams) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(rows * bits + cell, minlength=(len(offsets) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(a: str, b: str) -> Column:
    """How many elements two sets differ in at least, by their parities."""
    return reduce(add, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(MARKS)])


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """no, size, grams, cells, marks: the set of each class, its histogram and its parities, once per task (equal rows, of one id and text, may lie in several)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            offsets, grams = sets(batch.column("words"), n)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(grams))
            no = batch.column("no").to_numpy()
            fresh = np.flatnonzero(np.append(no[:1] != last, no[1:] != no[:-1]))  # the join has brought equal rows together
            last = no[-1] if len(no) else last
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * CELLS
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(histograms(offsets, grams)))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * MARKS
            marks = pa.ListArray.from_arrays(pa.array(ends), pa.array(parities(offsets, grams)))
            yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("size"), lists, cells, marks],
                                             ["no", "size", "grams", "cells", "marks"]).take(pa.array(fresh))

    return docs.mapInArrow(run, "no long, size long, grams array<long>, cells array<int>, marks array<long>")


def _measured(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """a, b, shared, total of pairs of classes: the common elements, and the sizes of both sets together."""
    left = kept.select(F.col("no").alias("a"), F.col("grams").alias("ga"))
    right = kept.select(F.col("no").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(right, "b").join(left, "a").select(
        *pairs.columns, F.size(F.array_intersect("ga", "gb")).cast("long").alias("shared"),
        (F.size("ga") + F.size("gb")).cast("long").alias("total")).distinct()


def _are_linked(t: Fraction) -> Column:
    return F.col("shared") * t.denominator >= (F.col("total") - F.col("shared")) * t.numerator


def _fits(a: str, b: str, t: Fraction) -> Column:
    return (F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator)


def _may_link(x: str, y: str, t: Fraction) -> Column:
    """Whether sets whose first common element is at ``place`` can be linked."""
    size, place = F.col(f"{x}size") + F.col(f"{y}size"), F.col(f"{x}place") + F.col(f"{y}place")
    return _fits(f"{x}size", f"{y}size", t) & (place * (t.denominator + t.numerator) <= size * (t.denominator - t.numerator))


def linked(df: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, digest (xxhash64 of the text), n_shingles, component_id (the smallest id reachable by links) per row, and
    whether the row ``stands`` for its component."""
    with session.scratch(df.sparkSession) as written:
        return session.written(_linked(df, n, threshold, text, key, written), "linked")


def _linked(df: DataFrame, n: int, threshold: Fraction, text: str, key: str, written) -> DataFrame:
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1 or n < 1:
        raise ValueError("the threshold is above 0 and at most 1, n at least 1")
    docs = df.select(_id(key).alias("id"), _digest(text).alias("digest"), F.col(text).alias("text"))
    split = common.words(common.lower_ascii(F.col("text"))).alias("words")
    rows = written(_classes(docs.select("id", "digest", split), n), "rows")
    classes = rows.where("size > 0").groupBy("size", "d1", "d2").agg(
        F.min("id").alias("first"), F.min_by("digest", "id").alias("digest"))
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    # 2. Classes that share enough parts with others. (Copies of a class in other tasks may count a part twice, so more stay.)
    shared = _signatures(docs.select(split), n, t)
    inside = F.expr("lag(d1) OVER (PARTITION BY part ORDER BY d1) <> d1 OR lead(d1) OVER (PARTITION BY part ORDER BY d1) <> d1")
    met_parts = shared.withColumn("met", inside).where("met").groupBy("d1", "rule").agg(F.count("*").alias("n"))
    alive = written(met_parts.where("n >= floor(rule / 2)").select("d1").distinct(), "alive")
    wanted = written(classes.join(alive, "d1").select("no", "size", "first", "digest"), "wanted")
    # 3. Their sets, and prefixes from the rarest n-gram. Sets are larger than texts, so they are made where they are written.
    again = docs.join(wanted.select(F.col("first").alias("id"), "digest", "no", "size").hint("merge"), ["id", "digest"]).select("no", "size", split)
    kept = written(_sets(again, n), "sets")
    each = kept.select("no", "size", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    prefix = F.col("size") - F.ceil(F.col("size") * t.numerator / F.lit(float(t.denominator)) - 1e-9) + 1
    held = each.join(counts, "gram").groupBy("no", "size").agg(F.array_sort(F.collect_set(F.struct("n", "gram"))).alias("held"))
    # Elements of one class alone are the rarest of all: they take the first places of the prefix.
    lone = F.col("size") - F.size("held")
    places = (prefix - lone).cast("int")
    prefixes = held.where(places > 0).select("no", "size", lone.alias("lone"), F.slice("held.gram", F.lit(1), places).alias("prefix"))
    prefixes = written(prefixes.withColumn("group", F.xxhash64("size", "lone", "prefix")), "prefixes")
    # 4. Groups, their lists, and stars.
    groups = written(prefixes.groupBy("group").agg(
        F.min("no").alias("head"), F.first("size").alias("size"), F.first("lone").alias("lone"), F.first("prefix").alias("prefix")), "groups")
    posts = groups.select("group", "head", "size", "lone", F.posexplode("prefix").alias("nth", "gram"))
    posts = written(posts.withColumn("place", F.col("lone") + F.col("nth")), "posts")
    members = prefixes.select("group", "no", "size")
    # Of copies with changes of their own, the one with the fewest n-grams of its own is nearest to all others.
    heads = posts.groupBy("gram").agg(F.min(F.struct("lone", "head", "size", "place")).alias("hub")).select(
        "gram", F.col("hub.head").alias("a"), F.col("hub.size").alias("hub_size"), F.col("hub.place").alias("hub_place"))
    stars = posts.join(heads, "gram").where(_may_link("", "hub_", t)).select("a", "group").distinct()
    own = prefixes.join(groups.select("group", F.col("head").alias("a")), "group").select("a", F.col("no").alias("b"))
    first = stars.join(members, "group").select("a", F.col("no").alias("b")).unionByName(own).where("a <> b").distinct()
    measured = written(_measured(written(first, "stars"), kept), "measured")
    edges = measured.where(_are_linked(t)).select("a", "b")
    known = graph.components(edges, written)
    # What is in different components and meets in a list; ``far``: the distance to the first class of the own group.
    distance = F.col("total") - 2 * F.col("shared")
    far = own.join(measured, ["a", "b"]).select(F.col("b").alias("no"), distance.alias("far"))
    tagged = members.join(known.withColumnRenamed("node", "no"), "no", "left").join(far, "no", "left")
    tagged = written(tagged.select("group", "no", "size", F.coalesce("component", "no").alias("component"), F.coalesce("far", F.lit(0)).alias("far")), "tagged")
    held_by = tagged.groupBy("group", "component").agg(F.count("*").alias("n"), F.max("far").alias("spread"), F.min(F.struct("far", "no")).alias("near"))
    # One of the members of a component in a group, and how far the others are from it at most.
    held_by = held_by.select("group", "component", "n", "spread", F.col("near.no").alias("one"),
                             F.when(F.col("n") == 1, 0).otherwise(F.col("near.far") + F.col("spread")).alias("radius"))
    # How far the first class of a group is from that of its list: where both are known, they bound the distance of two groups.
    centre = measured.select("a", F.col("b").alias("head"), distance.alias("off"))
    placed = posts.join(heads.select("gram", "a"), "gram").join(centre, ["a", "head"], "left").select(
        "group", "head", "size", "place", "nth", "gram", F.when(F.col("a") == F.col("head"), 0).otherwise(F.col("off")).alias("off"))
    lists = written(placed.join(held_by, "group"), "lists")
    mixed = lists.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    open_lists = written(lists.join(mixed, "gram").join(groups.select("group", "prefix"), "group"), "open")
    ones = kept.select(F.col("no").alias("one"), "marks").join(open_lists.select("one").distinct(), "one").dropDuplicates(["one"])
    marked = written(open_lists.join(ones, "one"), "marked")
    x, y = marked.alias("x"), marked.alias("y")
    # Members of one group meet at its first element, other groups at the first that both prefixes have.
    before = F.arrays_overlap(F.slice("x.prefix", F.lit(1), F.col("x.nth")), F.slice("y.prefix", F.lit(1), F.col("y.nth")))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.component") < F.col("y.component")))
    # Two members differ in no fewer elements than two others do, less what they are away from those.
    by_centre = F.abs(F.col("x.off") - F.col("y.off")) - F.col("x.spread") - F.col("y.spread")  # ``off`` may be unknown: null
    by_parity = _apart("x.marks", "y.marks") - F.col("x.radius") - F.col("y.radius")
    bound = F.greatest(by_centre, by_parity) * (t.denominator + t.numerator) <= (F.col("x.size") + F.col("y.size")) * (t.denominator - t.numerator)
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & smaller
                 & _may_link("x.", "y.", t) & bound & ~before).select(
        F.col("x.group").alias("ag"), F.col("x.component").alias("ac"), F.col("y.group").alias("bg"), F.col("y.component").alias("bc"),
        F.col("y.head").alias("b"), F.col("y.size").alias("bs"), F.col("y.spread").alias("spread"))
    # The smaller side against the other group's first class; what is linked so is one component from here on. Pairs whose
    # histograms differ by more than links do are none. All members of a group have one size.
    cells = kept.select("no", "cells").dropDuplicates(["no"])
    tagged = written(tagged.join(cells, "no"), "celled")

    def at_most(difference: Column) -> Column:
        return difference * (t.denominator + t.numerator) <= (F.col("a_size") + F.col("b_size")) * (t.denominator - t.numerator)

    asking = tagged.select(F.col("group").alias("ag"), F.col("component").alias("ac"), F.col("no").alias("a"), F.col("size").alias("a_size"),
                           F.col("cells").alias("a_cells")).alias("x")
    asked = met.select("ag", "ac", "b", "bg", "bc", F.col("bs").alias("b_size"), "spread").join(
        cells.select(F.col("no").alias("b"), F.col("cells").alias("b_cells")), "b").alias("y")
    probes = asking.join(asked, (F.col("x.ag") == F.col("y.ag")) & (F.col("x.ac") == F.col("y.ac"))
                         & at_most(_differ("a_cells", "b_cells") - F.col("spread")))  # no member is farther from the first class
    probes = written(probes.select("a", "a_size", "a_cells", "b", "b_size", "bg", "bc", at_most(_differ("a_cells", "b_cells")).alias("near")).distinct(), "probes")
    probed = written(_measured(probes.where("near").select("a", "b").distinct(), kept), "probed")
    edges = written(edges.unionByName(probed.where(_are_linked(t)).select("a", "b")), "edges")
    joined = graph.components(edges, written).withColumnRenamed("node", "no")
    now = F.coalesce("component", "no")
    # Then against those members, of other components still, that may be near enough: by their histograms, and, where its distance
    # to the first class was measured, by that.
    others = tagged.withColumnRenamed("component", "bc").join(joined, "no", "left").select(
        F.col("group").alias("bg"), "bc", F.col("no").alias("other"), "far", F.col("cells").alias("other_cells"), now.alias("other_now")).alias("y")
    known_far = probed.select("a", "b", distance.alias("apart"))
    asking = probes.join(known_far, ["a", "b"], "left").withColumnRenamed("a", "no").join(joined, "no", "left").select(
        F.col("no").alias("a"), "a_size", "a_cells", "b_size", "bg", "bc", "apart", now.alias("a_now")).alias("x")
    rest = asking.join(others, (F.col("x.bg") == F.col("y.bg")) & (F.col("x.bc") == F.col("y.bc")) & (F.col("a_now") != F.col("other_now"))
                       & F.coalesce(at_most(F.abs(F.col("apart") - F.col("far"))), F.lit(True)) & at_most(_differ("a_cells", "other_cells")))
    rest = rest.select("a", F.col("other").alias("b")).distinct()
    more = written(_measured(written(rest, "rest"), kept).where(_are_linked(t)).select("a", "b"), "edges")
    whole = graph.components(edges.unionByName(more), written).withColumnRenamed("node", "no")
    # Ids: classes to components, rows to classes.
    named = classes.join(whole, "no", "left").withColumn("component", F.coalesce("component", "no"))
    lowest = named.groupBy("component").agg(F.min(F.struct("first", "digest")).alias("low"))
    named = named.join(lowest, "component").select("size", "d1", "d2", F.col("low.first").alias("component_id"), F.col("low.digest").alias("low_digest"))
    known_rows = rows.join(named, ["size", "d1", "d2"], "left")
    shown = [F.when(F.col(c) != LAST, F.col(c)) for c in ("id", "component_id")]
    stands = F.col("low_digest").isNull() | ((F.col("id") == F.col("component_id")) & (F.col("digest") == F.col("low_digest")))
    return known_rows.withColumn("stands", stands).withColumn("component_id", F.coalesce("component_id", "id")).select(
        shown[0].alias(key), "digest", F.col("size").alias("n_shingles"), shown[1].alias("component_id"), "stands")


def one_of_each(df: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without those linked to one that stays: of each component the row with the smallest id stays
    (of rows with that id, the one with the smallest digest of its text, and of equal ones any). Rows with an empty set stay."""
    found = linked(df, n, threshold, text, key).where("stands")
    stay = session.written(found.select(_id(key).alias("__id"), F.col("digest").alias("__digest"), (F.col("n_shingles") > 0).alias("__once")).distinct(), "stay")
    rows = df.withColumns({"__id": _id(key), "__digest": _digest(text)}).join(stay.hint("merge"), ["__id", "__digest"])
    number = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(F.lit(1)))
    return rows.withColumn("__no", number).where(~F.col("__once") | (F.col("__no") == 1)).drop("__id", "__digest", "__once", "__no")
