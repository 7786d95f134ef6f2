"""Row filters over a table of files. Path predicates are plain column expressions, so they
run before ``content`` is decoded and are combined with the scan's own filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import fixed, session
from corpuscope.functions import globs, paths, sensitive

# Alternatives per regular expression; longer rule lists become several expressions.
RULES_PER_EXPRESSION = 500


def not_ignored(files: DataFrame, dialect: str = "tree", path: str = "relative_path") -> DataFrame:
    """Drop paths that hit a built-in ignore pattern."""
    patterns = {
        "tree": fixed.TREE_IGNORE_PATTERNS, "document": fixed.DOCUMENT_IGNORE_PATTERNS,
    }[dialect]
    return files.filter(~paths.matches_any(F.col(path), patterns))


def rule_regex(body):
    """The expression, over a whole path, of a rule's (text or column): it ends at the path's end or at a directory's."""
    before, after = "^(?:", r")(?:\z|(?=/)|(?<=/))"
    return f"{before}{body}{after}" if isinstance(body, str) else F.concat(F.lit(before), body, F.lit(after))


def rule_hit(path: Column, patterns: Sequence[str]) -> Column:
    """True when the path or one of its ancestor directories (with or without a trailing
    slash) matches an ignore rule as a whole."""
    hit = F.lit(False)
    for at in range(0, len(patterns), RULES_PER_EXPRESSION):
        rules = patterns[at: at + RULES_PER_EXPRESSION]
        either = "|".join(globs.shell_regex(p) for p in rules)
        hit = hit | path.rlike(rule_regex(either))
    return hit


def outside_rules(
    files: DataFrame, patterns: Sequence[str], path: str = "relative_path"
) -> DataFrame:
    return files.filter(~rule_hit(F.col(path), patterns))


def outside_globs(
    files: DataFrame,
    patterns: Iterable[str] = tuple(fixed.DEFAULT_EXCLUDE_GLOBS),
    path: str = "relative_path",
) -> DataFrame:
    return files.filter(
        ~paths.matches_any(F.col(path), [globs.path_regex(p) for p in patterns]))


def of_types(
    files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
    name: str = "file_name",
) -> DataFrame:
    """Keep included extensions (none given or ``*``: all), drop excluded ones."""
    if include and "*" not in include:
        files = files.filter(paths.last_piece(F.col(name)).isin(*include))
    for kind in exclude:
        files = files.filter(~F.col(name).endswith(f".{kind}"))
    return files


def text_only(files: DataFrame, dialect: str = "tree", name: str = "file_name") -> DataFrame:
    """Drop binary extensions. The document dialect looks at what follows the last dot, so a
    bare name such as ``png`` counts as its own extension there."""
    denied = fixed.BINARY_EXTENSIONS[dialect]
    if dialect == "document":
        key = F.concat(F.lit("."), F.lower(paths.last_piece(F.col(name))))
    else:
        key = paths.suffix(F.col(name))
    return files.filter(~key.isin(*denied))


def outside_directories(
    files: DataFrame, prefixes: Sequence[str], path: str = "relative_path"
) -> DataFrame:
    """Drop files with any path component (the name included) that starts with a prefix."""
    for prefix in prefixes:
        slashed = F.concat(F.lit("/"), F.col(path))
        files = files.filter(~slashed.contains(f"/{prefix}"))
    return files


def within_size(
    files: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES, size: str = "size"
) -> DataFrame:
    return files.filter(F.col(size) <= max_bytes)


def selected(files: DataFrame, selection: DataFrame, key: str = "relative_path") -> DataFrame:
    """Keep chosen files. Both sides are keyed by path; Spark picks the join by measured size."""
    return files.join(selection.select(key), key, "left_semi")


def saved_documents(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("scheme") == "file") & ~F.col("is_untitled"))


def changed_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """Drop files whose path and hash equal the previous run's. Only paths and hashes are
    compared; contents join the paths that remain."""
    before = state.select(
        F.col("relative_path").alias("_path"), F.col("content_hash").alias("_hash"))
    same = (F.col("relative_path") == F.col("_path")) & F.col("content_hash").eqNullSafe(
        F.col("_hash"))
    if "content" not in files.columns:
        return files.join(before, same, "left_anti")
    keys = files.select("relative_path", "content_hash").join(before, same, "left_anti")
    return selected(files, session.written(keys.select("relative_path"), "changed"))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Drop references without source, target or type."""
    keep = F.lit(True)
    for name in ("source", "target", "type"):
        keep = keep & (F.coalesce(F.col(name), F.lit("")) != "")
    return edges.filter(keep)


POLICIES = ("warn", "redact", "skip", "ignore")


def apply_sensitive_policy(
    files: DataFrame,
    policy: str | Column,
    patterns: Iterable[sensitive.SensitivePattern] = tuple(sensitive.BUILT_IN_PATTERNS),
) -> DataFrame:
    """``warn`` keeps and flags, ``redact`` masks, ``skip`` drops the file, ``ignore`` keeps.
    ``policy`` may be a column, for a policy per file. Adds ``is_flagged``."""
    patterns = list(patterns)
    if isinstance(policy, str):
        if policy not in POLICIES:
            raise ValueError(f"unknown policy: {policy}")
        policy = F.lit(policy)
    content = F.col("content")
    flagged = files.withColumn("_hit", sensitive.is_sensitive(content, patterns)).withColumn(
        "_policy", policy)
    kept = flagged.filter(~(F.col("_hit") & (F.col("_policy") == "skip")))
    masked = F.when(
        F.col("_hit") & (F.col("_policy") == "redact"), sensitive.redacted(content, patterns)
    ).otherwise(content)
    return kept.withColumn("content", masked).withColumn(
        "is_flagged", F.col("_hit") & (F.col("_policy") == "warn")).drop("_hit", "_policy")
