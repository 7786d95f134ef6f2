"""Glob patterns to regular expressions. Both dialects yield expressions without
look-around, so that they mean the same in every regex engine."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_CLASS = re.compile(r"\[[!^]?\]?[^\]]*\]")


def _char_class(text: str) -> str:
    body = text[1:-1]
    negate = body[:1] in ("!", "^")
    body = body[1:] if negate else body
    body = body.replace("\\", r"\\").replace("[", r"\[").replace("]", r"\]").replace("&&", r"\&\&")
    return f"[{'^' if negate else ''}{body}]"


def _pieces(pattern: str) -> list[str]:
    """Split a glob into runs: wildcards, classes and single literal characters."""
    out, at = [], 0
    while at < len(pattern):
        found = _CLASS.match(pattern, at)
        piece = found.group() if found and pattern[at] == "[" else pattern[at]
        out.append(piece)
        at += len(piece)
    return out


def shell_regex(pattern: str) -> str:
    """Dialect of ignore rules: ``*`` and ``?`` also match ``/``. Not anchored."""
    rendered = []
    for piece in _pieces(pattern):
        if piece == "*":
            if rendered[-1:] != [r"[\s\S]*"]:
                rendered.append(r"[\s\S]*")
        elif piece == "?":
            rendered.append(r"[\s\S]")
        elif len(piece) > 1:
            rendered.append(_char_class(piece))
        else:
            rendered.append(re.escape(piece) if not piece.isalnum() else piece)
    return "".join(rendered)


# Wildcards, whole classes, literal runs, and brackets that open no class.
TOKEN = r"(?s)\[!?\]?[^\]]*\]|\*+|\?|[^*?\[]+|\["


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s/_])", r"\\$1")


def _class_column(token: Column) -> Column:
    """A class without its reversed ranges; one that is left with nothing matches nothing, or if negated anything."""
    negated = token.startswith("[!")
    body = F.substring(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
    items = F.regexp_extract_all(body, F.lit(r"(?s).-.|."), F.lit(0))

    def is_range(item: Column) -> Column:
        return F.length(item) == 3

    sound = F.filter(items, lambda item: ~is_range(item) | (F.substring(item, 1, 1) <= F.substring(item, 3, 1)))
    spelled = F.array_join(F.transform(sound, lambda item: F.when(is_range(item), F.concat(
        _escaped(F.substring(item, 1, 1)), F.lit("-"), _escaped(F.substring(item, 3, 1)))).otherwise(_escaped(item))), "")
    return (F.when(spelled != "", F.concat(F.when(negated, "[^").otherwise("["), spelled, F.lit("]")))
            .when(negated, r"[\s\S]").otherwise("(?!)"))


def shell_regex_column(pattern: Column) -> Column:
    """``shell_regex`` of a column of globs, which may hold anything. Not anchored."""
    tokens = F.regexp_extract_all(pattern, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, lambda token: (
        F.when(token.startswith("*"), r"[\s\S]*").when(token == "?", r"[\s\S]")
        .when(token.startswith("[") & (F.length(token) > 1), _class_column(token)).otherwise(_escaped(token)))), "")


def expand_braces(pattern: str) -> list[str]:
    """``a.{x,y}`` -> ``a.x``, ``a.y`` (also nested)."""
    found = re.search(r"\{([^{}]*,[^{}]*)\}", pattern)
    if not found:
        return [pattern]
    head, tail = pattern[: found.start()], pattern[found.end():]
    return [done for choice in found.group(1).split(",")
            for done in expand_braces(head + choice + tail)]


def _segment(text: str) -> str:
    """One path segment; wildcards stay inside it and never match a leading dot."""
    pieces = _pieces(text)
    rendered = []
    for at, piece in enumerate(pieces):
        first = at == 0
        if piece == "*":
            if at and pieces[at - 1] == "*":
                continue
            rest = "".join(pieces[at:]).lstrip("*")
            if not first:
                rendered.append("[^/]*")
            elif rest == "" or rest.startswith("."):
                rendered.append("[^/.][^/]*")
            else:
                rendered.append("(?:[^/.][^/]*)?")
        elif piece == "?":
            rendered.append("[^/.]" if first else "[^/]")
        elif len(piece) > 1:
            rendered.append(_char_class(piece))
        else:
            rendered.append(re.escape(piece) if not piece.isalnum() else piece)
    return "".join(rendered)


def path_regex(pattern: str) -> str:
    """Dialect of exclusion globs: ``*`` stays in a segment, ``**`` crosses. Anchored."""
    choices = []
    for plain in expand_braces(pattern):
        segments = plain.split("/")
        rendered = ""
        for at, segment in enumerate(segments):
            last = at == len(segments) - 1
            if segment == "**":
                rendered += "[^/.][^/]*(?:/[^/.][^/]*)*" if last else "(?:[^/.][^/]*/)*"
            else:
                rendered += _segment(segment) + ("" if last else "/")
        choices.append(rendered)
    return "^(?:" + "|".join(choices) + ")$"


# How what is left of an ignore line begins, and the globs that it then stands for; the first that fits.
_LINE_SHAPES = [(re.compile(start), shapes) for start, shapes in (
    ("[*/]", ["{}"]), (".*/", ["**/{}"]), ("", ["{}/**", "{}"]))]


def ignore_patterns(lines: Iterable[str]) -> list[str]:
    """The globs of ignore-file lines; ``sources.ignore.rules_from_lines`` is the same for a table of lines."""
    rules = (line.strip() for line in lines)
    plain = [rule.rstrip("/").removeprefix("/") for rule in rules if not re.match("#|$", rule)]
    return [shape.replace("{}", rule) for rule in plain
            for shape in next(shapes for start, shapes in _LINE_SHAPES if start.match(rule))]
