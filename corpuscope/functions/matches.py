"""Pattern matches with their position, computed inside the row.

A text is cut into the pieces between matches; the position of a match is the running sum of
the lengths before it. Nothing is shuffled, and the work is linear in the text. The engine goes over a text
once per pattern: every match is replaced by itself and its groups between marks, and plain splits at the marks
do the rest. Texts that hold a mark themselves are cut by several passes of the pattern instead."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuscope.functions.text import let, scan

# Private-use characters before a match, between it and its groups, and after them.
OPEN, NEXT, CLOSE = "\ue0f0", "\ue0f1", "\ue0f2"


def _marked(content: Column, pattern: str, groups: dict[str, int]) -> Column:
    """array<struct(matched, <groups...>, gap)>, ``gap`` being the text before the match."""
    shape = OPEN + NEXT.join(f"${group}" for group in (0, *groups.values())) + CLOSE

    def hit(piece: Column, gap: Column) -> Column:
        fields = F.split(F.substring_index(piece, CLOSE, 1), NEXT, -1)
        return let(fields, lambda f: F.struct(
            *[F.get(f, F.lit(i)).alias(name) for i, name in enumerate(["matched", *groups])], gap.alias("gap")))

    def hits(pieces: Column) -> Column:
        gaps = F.transform(pieces, lambda p: F.substring_index(p, CLOSE, -1))
        return let(gaps, lambda g: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, i: hit(p, F.get(g, i))))

    return let(F.split(F.regexp_replace(content, F.lit(pattern), F.lit(shape)), OPEN, -1), hits)


def _passes(content: Column, pattern: str, groups: dict[str, int]) -> Column:
    """The same by one pass per group and one for the gaps. A match of nothing at the very start has no gap before it."""
    names = ["matched", *groups]
    found = [F.regexp_extract_all(content, F.lit(pattern), F.lit(group)).alias(name)
             for name, group in zip(names, [0, *groups.values()], strict=True)]
    gaps = F.split(content, pattern, -1)
    whole = F.when(F.size(gaps) == F.size(found[0]), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps).alias("gap")
    # The piece after the last match belongs to none.
    return F.filter(F.arrays_zip(*found, whole), lambda hit: hit["matched"].isNotNull())


def located(content: Column, pattern: str, groups: dict[str, int]) -> Column:
    """array<struct(matched, <groups...>, start, end, line, character)> of all matches of
    ``pattern``, as the engine finds them; those of nothing are left out. Groups are taken where the pattern matched, so it
    may look around itself; a group without a match is empty.

    ``start``/``end`` are 0-based code point offsets (end excluded), ``line`` and ``character``
    the 0-based position of the start."""
    names = ["matched", *groups]
    kind = "array<struct<" + ", ".join(f"{name}: string" for name in [*names, "gap"]) + ">>"
    own = F.contains(content, F.lit(OPEN)) | F.contains(content, F.lit(NEXT)) | F.contains(content, F.lit(CLOSE))
    hits = F.when(own, _passes(content, pattern, groups).cast(kind)).otherwise(_marked(content, pattern, groups).cast(kind))
    state_type = "struct<at:int, line:int, character:int>"

    def feeds(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def column_after(before: Column, text: Column) -> Column:
        tail = F.length(F.substring_index(text, "\n", -1))
        return F.when(F.contains(text, F.lit("\n")), tail).otherwise(before + F.length(text))

    def over(state: Column, text: Column) -> Column:
        return F.struct((state["at"] + F.length(text)).alias("at"), (state["line"] + feeds(text)).alias("line"),
                        column_after(state["character"], text).alias("character"))

    def emit(state: Column, hit: Column) -> Column:
        start = over(state, hit["gap"])
        return F.struct(*[hit[name].alias(name) for name in names], start["at"].alias("start"),
                        (start["at"] + F.length(hit["matched"])).alias("end"),
                        start["line"].alias("line"), start["character"].alias("character"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"), F.lit(0).alias("character"))
    every = scan(hits, zero, state_type, lambda state, hit: over(over(state, hit["gap"]), hit["matched"]), emit)
    return F.filter(every, lambda hit: hit["matched"] != "")
