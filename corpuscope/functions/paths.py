"""Columns derived from a file path (always ``/`` separated and relative to the root)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from corpuscope import fixed


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Parent directory, ``.`` at the root."""
    above = F.regexp_replace(F.concat(F.lit("./"), path), r"/[^/]*$", "")
    return F.regexp_replace(above, r"^\./", "")


def directory_name(path: Column) -> Column:
    return file_name(directory(path))


def suffix(name: Column) -> Column:
    """Last extension with its dot, in lower case; empty for names like ``.env``."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def last_piece(name: Column) -> Column:
    """What follows the last dot, or the whole name when there is none."""
    return F.substring_index(name, ".", -1)


def parts(path: Column) -> Column:
    return F.struct(
        file_name(path).alias("file_name"),
        directory(path).alias("directory"),
        directory_name(path).alias("directory_name"),
        suffix(file_name(path)).alias("ext"),
    )


def ancestors(path: Column) -> Column:
    """Array of all proper ancestor directories, nearest first."""
    pieces = F.split(path, "/")
    depth = F.size(pieces) - 1
    walk = F.transform(
        F.sequence(depth, F.lit(1), F.lit(-1)),
        lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"),
    )
    return F.when(depth > 0, walk).otherwise(F.array().cast("array<string>"))


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def language(path: Column, dialect: str = "tree") -> Column:
    table = dict(fixed.LANGUAGES)
    if dialect == "document":
        table.update(fixed.DOCUMENT_LANGUAGES)
    elif dialect != "tree":
        raise ValueError(f"unknown dialect: {dialect}")
    return F.coalesce(_lookup(suffix(file_name(path)), table), F.lit(fixed.DEFAULT_LANGUAGE))


def fence_label(language_id: Column, custom: Mapping[str, str] | None = None) -> Column:
    table = {**fixed.FENCE_LABELS, **(custom or {})}
    return F.coalesce(_lookup(language_id, table), language_id)


def normalize(path: Column) -> Column:
    """Resolve ``.`` and ``..`` inside a relative path; leading ``..`` stay."""
    pieces = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, piece: Column) -> Column:
        can_pop = (
            (piece == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        )
        return F.when(can_pop, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
                      ).otherwise(F.concat(done, F.array(piece)))

    return F.array_join(F.aggregate(pieces, F.array().cast("array<string>"), step), "/")


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Unanchored search of a list of regular expressions, as one expression."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{p})" for p in patterns))
