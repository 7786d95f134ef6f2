"""Reuse of stored analyses, keyed by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session


def split_work(files: DataFrame, stored: DataFrame) -> DataFrame:
    """One path per content that no stored analysis covers: (content_hash, relative_path).
    Copies collapse in the partial aggregation, before anything moves."""
    firsts = files.groupBy("content_hash").agg(F.min("relative_path").alias("relative_path"))
    return firsts.join(stored.select("content_hash"), "content_hash", "left_anti")


def reuse_analysis(
    files: DataFrame, stored: DataFrame, analyse: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(analysis of every file, new store). ``stored`` has ``content_hash`` and result columns;
    ``analyse`` maps files to ``content_hash`` and the same columns. Only new contents are
    analysed, each once however many copies there are."""
    todo = split_work(files.select("relative_path", "content_hash"), stored)
    todo = session.written(todo.select("relative_path"), "todo")
    fresh = analyse(files.join(todo, "relative_path", "left_semi"))
    store = stored.unionByName(fresh.select(*stored.columns))
    return files.select("relative_path", "content_hash").join(store, "content_hash"), store


def version_rank(at: str = "ts", content: str = "content_hash", of: str = "") -> Column:
    """What orders the edits of a path: the time, then the hash; an edit without a hash (a removal) comes first of its time."""
    return F.struct(F.col(f"{of}{at}"), F.col(f"{of}{content}"))


def latest_versions(edits: DataFrame, key: str = "path", at: str = "ts", content: str = "content_hash") -> DataFrame:
    """The last edit per path, by ``version_rank``; the other columns decide what is left undecided. ``max`` keeps one row
    per path and task before the shuffle."""
    first = [at, *([content] if content in edits.columns else [])]
    rest = [c for c in edits.columns if c not in (key, *first)]
    return edits.groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("last")).select(key, "last.*").select(*edits.columns)
