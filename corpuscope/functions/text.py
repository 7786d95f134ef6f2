"""Columns derived from text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\u000b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


SCAN_RUN = 64


def scan(items: Column, zero: Column, state_type: str, advance: Callable[[Column, Column], Column],
         emit: Callable[[Column, Column], Column]) -> Column:
    """``emit(state, item)`` of every item of an array, in order, where ``advance`` carries the state on.

    An array that grows element by element is copied each time, so the items are taken in runs: the
    states at the starts of the runs first, then those inside each run. Only states are copied, and
    up to some ten thousand items the copies grow with the items alone."""
    states = f"array<{state_type}>"

    def cut(values: Column) -> Column:
        last = F.greatest(F.size(values) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last, F.lit(SCAN_RUN)), lambda at: F.slice(values, at + 1, F.lit(SCAN_RUN)))

    def before_each(steps: Column, start: Column, go: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(
            steps, F.struct(start.cast(state_type).alias("state"), F.array().cast(states).alias("out")),
            lambda acc, step: F.struct(
                go(acc["state"], step).cast(state_type).alias("state"),
                F.concat(acc["out"], F.array(acc["state"])).cast(states).alias("out")),
            lambda acc: acc["out"])

    def of_run(run: Column, start: Column) -> Column:
        return F.zip_with(run, before_each(run, start, advance), lambda item, state: emit(state, item))

    def whole_run(state: Column, run: Column) -> Column:
        return F.aggregate(run, state, lambda at, item: advance(at, item).cast(state_type))

    return let(let(items, cut), lambda runs: F.flatten(F.zip_with(runs, before_each(runs, zero, whole_run), of_run)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """All pieces between line feeds; a final line feed yields a last empty piece."""
    return F.split(text, "\n")


def whole_lines(text: Column) -> Column:
    """Lines without the empty piece after a final line feed (line feeds only)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits become ``-``, outer ones cut."""
    return F.btrim(untrimmed_slug(text), F.lit("-"))


def untrimmed_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")


# Escapes in the order they are applied.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
APOSTROPHES = {"tree": "&#39;", "document": "&#039;"}


def html_escape(text: Column, dialect: str = "tree") -> Column:
    for raw, escaped in [*HTML_ESCAPES, ("'", APOSTROPHES[dialect])]:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def _scaled(size: Column, units: list[str], digits: int, round_half_even: bool) -> Column:
    out = None
    for power, unit in reversed(list(enumerate(units))):
        value = size.cast("double") / float(1024 ** power)
        value = F.bround(value, digits) if round_half_even else F.round(value, digits)
        label = F.format_string(f"%.{digits}f {unit}", value)
        if out is None:
            out = label
        else:
            out = F.when(size < 1024 ** (power + 1), label).otherwise(out)
    return out


def size_label(size: Column, style: str = "tree") -> Column:
    """Readable size. ``tree``: one decimal up to PB, ties to even; ``document``: one decimal
    up to GB, ties up; ``compact``: bytes below 1 KiB, else two decimals without zeros."""
    if style == "tree":
        return _scaled(size, ["B", "KB", "MB", "GB", "TB", "PB"], 1, True)
    if style == "document":
        return _scaled(size, ["B", "KB", "MB", "GB"], 1, False)
    if style == "compact":
        scaled = _scaled(size, ["B", "KB", "MB", "GB"], 2, False)
        return F.when(size < 1024, F.format_string("%d B", size.cast("long"))).otherwise(
            F.regexp_replace(scaled, r"\.?0+ ", " "))
    raise ValueError(f"unknown size style: {style}")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalized(text: Column, ignore_whitespace: bool = True, ignore_case: bool = False) -> Column:
    if ignore_whitespace:
        text = F.regexp_replace(strip(text), r"\s+", " ")
    return F.lower(text) if ignore_case else text


def snippet(text: Column) -> Column:
    """First three non-blank lines, and a mark when the text has more than three lines."""

    def body(pieces: Column) -> Column:
        shown = F.slice(F.filter(pieces, lambda p: strip(p) != ""), 1, 3)
        more = F.when(F.size(pieces) > 3, F.lit("\n...")).otherwise(F.lit(""))
        return F.concat(F.array_join(shown, "\n"), more)

    return let(lines(text), body)


def leading_blank_lines(text: Column) -> Column:

    def body(pieces: Column) -> Column:
        first = F.array_position(F.transform(pieces, lambda p: strip(p) != ""), True)
        return F.when(first > 0, first - 1).otherwise(F.size(pieces)).cast("int")

    return let(whole_lines(text), body)


def blank_lines_between(text: Column, start: Column, end: Column) -> Column:
    """Blank lines among lines ``start``..``end`` (1-based, both included)."""
    span = F.slice(whole_lines(text), start, F.greatest(end - start + 1, F.lit(0)))
    return F.size(F.filter(span, lambda p: strip(p) == ""))


def tag_parts(tag: Column) -> Column:
    """``scope/name`` -> struct(scope, name)."""
    pieces = F.split(tag, "/")
    return F.struct(
        F.coalesce(F.get(pieces, 0), F.lit("")).alias("scope"),
        F.coalesce(F.get(pieces, 1), F.lit("")).alias("name"),
    )


def dependency_parts(dependency: Column) -> Column:
    """``name@version`` -> struct(name, version); no version is null."""
    pieces = F.split(dependency, "@")
    return F.struct(
        F.get(pieces, 0).alias("name"), F.nullif(F.get(pieces, 1), F.lit("")).alias("version"))


def shown_line(zero_based_line: Column) -> Column:
    return zero_based_line + 1


def regex_literal(text: str) -> str:
    """Escape a plain string for use inside a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", text)
