"""Imports between files as a directed graph of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope import fixed
from corpuscope.functions import code, matches, paths
from corpuscope.functions import text as tx

# ``import`` with any clause before ``from``, a bare ``import``, or ``require(``.
IMPORT = r"""(?:import|require)\s*\(?\s*(?:[\w\s{},*$]+?\s*from\s*)?['"]([^'"]+)['"]"""


def import_array(content: Column) -> Column:
    """array<struct(matched, path, start, end, line, character)> of relative imports."""
    found = matches.located(content, IMPORT, {"path": 1})
    return F.filter(found, lambda hit: hit["path"].startswith("."))


def import_edges(files: DataFrame) -> DataFrame:
    """(source, import_path, line, character, symbol, context); positions are 0-based."""
    return (
        files.select(F.col("relative_path").alias("source"), F.inline(import_array(F.col("content"))))
        .select(
            "source", F.col("path").alias("import_path"), "line", "character",
            F.nullif(tx.strip(F.regexp_extract("matched", r"\{([^}]+)\}", 1)), F.lit("")).alias("symbol"),
            F.col("matched").alias("context")))


def import_targets(files: DataFrame) -> DataFrame:
    """(base, target): the file that an import of ``base`` reaches. Every file offers itself
    under its full path and under its path without extension; the first extension in order
    wins. Only the rank of the extension is aggregated: base and rank spell the path."""
    path = F.col("relative_path")
    offers = [F.struct(path.alias("base"), F.lit(fixed.IMPORT_EXTENSIONS.index("")).alias("rank"))]
    for rank, ext in enumerate(fixed.IMPORT_EXTENSIONS):
        if ext:
            stem = F.substring(path, F.lit(1), F.length(path) - len(ext))
            offers.append(F.when(path.endswith(ext), F.struct(
                stem.alias("base"), F.lit(rank).alias("rank"))))
    tail = F.element_at(F.array(*[F.lit(e) for e in fixed.IMPORT_EXTENSIONS]), F.col("rank") + 1)
    return (
        files.select(F.inline(F.array_compact(F.array(*offers))))
        .groupBy("base").agg(F.min("rank").alias("rank"))
        .select("base", F.concat("base", tail).alias("target")))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges that reach a file of the corpus: (source, target, type, line, character, symbol,
    context). Edges are joined once, on the normalised path, to one row per base; a target that
    very many files import only makes the edge side skewed, which is split at run time."""
    base = paths.normalize(F.concat_ws("/", F.nullif(paths.directory(F.col("source")), F.lit(".")),
                                       F.col("import_path")))
    return (
        edges.withColumn("base", base).join(import_targets(files), "base")
        .select("source", "target", F.lit("import").alias("type"), "line", "character", "symbol",
                "context"))


def cross_references(edges: DataFrame) -> DataFrame:
    """Both sides of every reference as rows (relative_path, direction, other, line, character,
    symbol, context); ``referencedBy`` has the last reference of every (source, target). A file
    that a third of the corpus imports has that many ``referencedBy`` rows, never one row that
    holds them all. The edges are computed once; a pair has as many rows as one text imports it."""
    where = ["line", "character", "symbol", "context"]
    later = Window.partitionBy("source", "target").orderBy(F.desc("line"), F.desc("character"))

    def side(path: str, direction: str, other: str) -> Column:
        return F.struct(F.col(path).alias("relative_path"), F.lit(direction).alias("direction"),
                        F.col(other).alias("other"), *where)

    both = F.array(side("source", "references", "target"),
                   F.when(F.col("_nth") == 1, side("target", "referencedBy", "source")))
    return edges.withColumn("_nth", F.row_number().over(later)).select(F.inline(F.array_compact(both)))


ARROWS = {"references": "→", "referencedBy": "←"}


def reference_line(depth: str = "detailed", style: str = "text") -> Column:
    """One report line of a ``cross_references`` row; the context only at full depth."""
    arrow = F.when(F.col("direction") == "references", ARROWS["references"]).otherwise(ARROWS["referencedBy"])
    symbol = F.when(F.col("symbol").isNotNull(), F.concat(F.lit(" ("), F.col("symbol"), F.lit(")")))
    at = F.when(F.col("line").isNotNull(), F.format_string(" - Line %d", tx.shown_line(F.col("line"))))
    lead, quote, context = {
        "text": ("  ", ("", ""), "\n    Context: "),
        "markdown": ("- ", ("`", "`"), "\n  - Context: "),
        "html": ('<li class="reference">', ("<code>", "</code>"), '\n<div class="context">Context: '),
    }[style]
    line = F.concat_ws("", F.lit(lead), arrow, F.lit(" " + quote[0]), F.col("other"), F.lit(quote[1]), symbol, at)
    if depth == "comprehensive":
        tail = "</div>" if style == "html" else ""
        line = F.concat_ws("", line, F.when(
            F.col("context").isNotNull(), F.concat(F.lit(context), F.col("context"), F.lit(tail))))
    return F.concat(line, F.lit("\n</li>")) if style == "html" else line


def reference_report(references: DataFrame, depth: str = "detailed", style: str = "text") -> DataFrame:
    return references.select("relative_path", "direction", "other", "line", "character",
                             reference_line(depth, style).alias("report_line"))


def package_dependencies(files: DataFrame) -> DataFrame:
    return files.select("relative_path", code.package_dependencies(F.col("content")).alias("dependencies"))
