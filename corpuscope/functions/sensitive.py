"""Sensitive values: patterns, detection and masking."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession, functions as F

from corpuscope.functions import matches
from corpuscope.functions import text as tx


@dataclass(frozen=True)
class SensitivePattern:
    """A value with the text around it; only the value is masked."""

    name: str
    before: str
    value: str
    after: str
    flags: str = "(?i)"
    # Whether some match may be empty; such a match is no hit.
    may_be_empty: bool = False
    # Lower-case texts one of which every match contains; none: unknown. They only spare the
    # pattern search of texts that cannot match.
    hints: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        if not self.before and not self.after:  # the whole match is the value; groups keep their numbers
            return f"{self.flags}{self.value}"
        return f"{self.flags}({self.before})({self.value})({self.after})"

    @property
    def groups(self) -> dict[str, int]:
        """The groups of the value and of the text before it, if any."""
        if not self.before and not self.after:
            return {"value": 0}
        return {"before": 1, "value": 2 + re.compile(self.before).groups}


# The built-in patterns.
_QUOTED = r"""['"]?\s*[:=]\s*['"]"""
BUILT_IN_PATTERNS = [
    SensitivePattern(
        "API Key",
        r"""['"]?(?:api[_-]?key|api[_-]?token|access[_-]?token|auth[_-]?token)""" + _QUOTED,
        r"""[^'"]+""", r"""['"]""", hints=("api", "access", "auth")),
    SensitivePattern(
        "Password", r"""['"]?(?:password|passwd|pwd)""" + _QUOTED, r"""[^'"]+""", r"""['"]""",
        hints=("passw", "pwd")),
    SensitivePattern(
        "Email", r"""['"]?(?:email|e-mail)""" + _QUOTED,
        r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"""['"]""", hints=("email", "e-mail")),
    SensitivePattern(
        "Private Key", "",
        r"-----BEGIN [^\n]+?PRIVATE KEY-----[^-]+?-----END [^\n]+?PRIVATE KEY-----", "", "",
        hints=("private key",)),
]


def _problem(expression: str) -> str | None:
    """What the engine that runs the patterns has against an expression. An expression that is seen to match nothing at all
    is most likely a mistake and reported; hits do not rely on it, as empty matches are no hits."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("custom patterns are compiled by Spark's engine, which needs an active session")
    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(f"(?iu){expression}")
    except Exception as problem:
        return str(getattr(problem, "java_exception", problem)).splitlines()[0]
    for probe in ("", "a", " a.", "_1\n-b"):
        matcher = compiled.matcher(probe)
        while matcher.find():
            if matcher.start() == matcher.end():
                return "matches the empty string"
    return None


def custom_patterns(expressions: Iterable[str]) -> list[SensitivePattern]:
    """User expressions; the whole match is the value. An expression that the engine refuses or that
    matches the empty string is reported and left out."""
    valid = []
    for expression in expressions:
        if problem := _problem(expression):
            warnings.warn(f"invalid custom pattern {expression!r}: {problem}", stacklevel=2)
            continue
        valid.append(SensitivePattern(expression, "", f"{expression}", "", "(?iu)", may_be_empty=True))
    return valid


MATCH_TYPE = (
    "array<struct<pattern_name:string, matched:string, value:string, start:int, end:int, "
    "value_start:int>>"
)


def _named(pattern: SensitivePattern):
    def row(hit: Column) -> Column:
        before = F.length(hit["before"]) if "before" in pattern.groups else F.lit(0)
        return F.struct(
            F.lit(pattern.name).alias("pattern_name"), hit["matched"].alias("matched"),
            hit["value"].alias("value"), hit["start"].alias("start"), hit["end"].alias("end"),
            (hit["start"] + before).cast("int").alias("value_start"),
        )

    return row


def _possible(lowered: Column, pattern: SensitivePattern) -> Column:
    hit = F.lit(not pattern.hints)
    for hint in pattern.hints:
        hit = hit | lowered.contains(hint)
    return hit


def found(content: Column, patterns: Iterable[SensitivePattern] = tuple(BUILT_IN_PATTERNS)) -> Column:
    """All matches of all patterns, in pattern order."""
    patterns = list(patterns)
    none = F.array().cast(MATCH_TYPE)

    def of(pattern: SensitivePattern, lowered: Column) -> Column:
        hits = matches.located(content, pattern.regex, pattern.groups)
        return F.when(_possible(lowered, pattern), F.transform(hits, _named(pattern)).cast(MATCH_TYPE)).otherwise(none)

    if not patterns:
        return none
    return tx.let(F.lower(content), lambda lowered: F.concat(*[of(pattern, lowered) for pattern in patterns]))


def is_sensitive(content: Column, patterns: Iterable[SensitivePattern] = tuple(BUILT_IN_PATTERNS)) -> Column:
    patterns = list(patterns)

    def any_hit(lowered: Column) -> Column:
        hit = F.lit(False)
        for pattern in patterns:
            found_one = content.rlike(pattern.regex)
            if pattern.may_be_empty:
                found_one = found_one & F.exists(F.regexp_extract_all(content, F.lit(pattern.regex), F.lit(0)), lambda m: m != "")
            hit = hit | (_possible(lowered, pattern) & found_one)
        return hit

    return tx.let(F.lower(content), any_hit)


def redacted(content: Column, patterns: Iterable[SensitivePattern] = tuple(BUILT_IN_PATTERNS)) -> Column:
    """Every matched value replaced by as many ``*``; the rest of the text is unchanged.
    Values are found in the original text, so overlapping hits mask their union."""
    spans = F.array_sort(F.transform(found(content, patterns), lambda h: F.struct(
        h["value_start"].alias("start"),
        (h["value_start"] + F.length(h["value"])).cast("int").alias("end"))))

    def piece(base: Column, region: Column):
        """The text from where the last span ended, and the masked rest of this one. Taken from the region of a run
        of spans, as a position in a long text has to be counted from its beginning."""
        def emit(at: Column, span: Column) -> Column:
            start = F.greatest(span["start"], at)
            return F.concat(F.substring(region, at - base + 1, start - at), F.repeat(F.lit("*"), F.greatest(span["end"] - start, F.lit(0))))
        return emit

    def reached(at: Column, span: Column) -> Column:
        return F.greatest(at, span["end"])

    def masked_run(acc: Column, run: Column) -> Column:
        end = F.aggregate(run, acc["at"], reached)
        region = F.substring(content, acc["at"] + 1, end - acc["at"])
        text = tx.let(region, lambda cut: F.array_join(
            tx.scan(run, acc["at"], "int", reached, piece(acc["at"], cut)), ""))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(text)).cast("array<string>").alias("out"))

    def masked(found_spans: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(found_spans) - 1, F.lit(tx.SCAN_RUN)),
                           lambda at: F.slice(found_spans, at + 1, F.lit(tx.SCAN_RUN)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        rebuilt = F.aggregate(runs, zero, masked_run, lambda acc: F.concat(
            F.array_join(acc["out"], ""), F.substring(content, acc["at"] + 1, F.length(content))))
        return F.when(F.size(found_spans) > 0, rebuilt).otherwise(content)

    return tx.let(spans, masked)
