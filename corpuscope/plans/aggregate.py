"""Whole runs: from a directory tree or a document table to a written report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from corpuscope import fixed, session
from corpuscope.operators import changes, filters, rollup, xref
from corpuscope.options import ReportOptions
from corpuscope.plans import sections, toc
from corpuscope.sources import files as fl
from corpuscope.sources import ignore, state, tree


def tree_scan(
    spark: SparkSession, root: str, exclude_dirs: list[str] | None = None,
    max_bytes: int = fixed.MAX_FILE_BYTES, observation: Observation | None = None,
) -> DataFrame:
    """Every file of a directory tree that path rules keep, with metadata columns and a ``reject_reason``:
    one table in the shared folder. Each file is opened once, and one above ``max_bytes`` never; files,
    notes, rejects, a change list and the next state are all read from the table, each only its columns.
    With an ``observation`` the rows are counted as they are written (``files.scan_counts``)."""
    listed = tree.list_tree(spark, root, tree.SKIPPED_DIRECTORIES)
    kept = fl.kept_paths(listed.filter("not is_dir"), ignore.pattern_list(spark, root), exclude_dirs, None)
    rows = fl.tagged(tree.read_bytes(kept, root, max_bytes), max_bytes)
    if observation is not None:
        rows = fl.scan_counts(rows, observation)
    return session.written(fl.described(rows), "scan")


def with_notes(scan: DataFrame) -> DataFrame:
    """The kept files of a scan and their notes."""
    return rollup.with_user_summaries(fl.kept_texts(scan))


def tree_files(
    spark: SparkSession, root: str, exclude_dirs: list[str] | None = None,
    max_bytes: int = fixed.MAX_FILE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(text files with metadata columns and notes, files that are not text) of a directory tree."""
    scan = tree_scan(spark, root, exclude_dirs, max_bytes)
    undecodable = fl.rejected(scan).filter(F.col("reject_reason") == fl.UNDECODABLE)
    return with_notes(scan), undecodable.drop("reject_reason")


def tree_report(files: DataFrame, style: str = "markdown", budget: int = fixed.CHAR_CHUNK_SIZE,
                extra_spacing: bool = True) -> DataFrame:
    """(part, relative_path, part_no, text): table of contents first, then the sections."""
    if style.lower() == "html":
        contents = sections.tree_html_toc(files)
    else:
        entries = toc.toc_entries(files, with_symbols=True)
        lead = F.repeat(F.lit("  "), F.col("level") - 1)
        contents = entries.select("relative_path", F.col("ord").alias("part_no"), F.concat(
            lead, F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")"),
            F.coalesce(F.concat(F.lit(" - "), "summary"), F.lit(""))).alias("text"))
    body = sections.tree_sections(files, style, budget, extra_spacing)
    return contents.withColumn("part", F.lit(1)).unionByName(body.withColumn("part", F.lit(2))).select(
        "part", "relative_path", "part_no", "text")


def with_changes(report: DataFrame, changed: DataFrame, style: str = "markdown") -> DataFrame:
    """Put the change report before (Markdown) or after (HTML) the report."""
    lines = changes.change_report(changed, "html" if style.lower() == "html" else "markdown")
    part = 3 if style.lower() == "html" else 0
    return report.unionByName(lines.select(
        F.lit(part).alias("part"),
        F.concat(F.col("section_no").cast("string"), F.lit("/"), F.col("row_no").cast("string"), F.lit("/"),
                 "relative_path").alias("relative_path"),
        "row_no", F.col("line").alias("text")).withColumnRenamed("row_no", "part_no"))


def aggregate_tree(
    spark: SparkSession, root: str, output: str, state_folder: str | None = None,
    incremental: bool = False, style: str = "markdown", budget: int = fixed.CHAR_CHUNK_SIZE,
    extra_spacing: bool = True, exclude_dirs: list[str] | None = None,
    max_bytes: int = fixed.MAX_FILE_BYTES, observation: Observation | None = None,
) -> DataFrame | None:
    """Write the report of a tree to ``output``; with a state folder also track changes since
    the last run (returned), and, if incremental, report only changed files. An ``observation``
    tells how many files were listed, kept and rejected."""
    files = with_notes(tree_scan(spark, root, exclude_dirs, max_bytes, observation))
    shown, changed = files, None
    if state_folder:
        before = state.load_state(spark, state_folder)
        changed = changes.track_changes(before, files)
        shown = filters.changed_since(files, before) if incremental else files
    report = tree_report(shown, style, budget, extra_spacing)
    if changed is not None:
        report = with_changes(report, changed, style)
    state.write_report(report, output, ["part", "relative_path", "part_no"])
    if state_folder:
        state.save_state(files, state_folder)
    return changed


def selected_documents(
    documents: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
    globs: list[str] | None = None,
) -> DataFrame:
    """The document filters: extensions, globs, binary types."""
    kept = filters.of_types(documents, include or [], exclude or [])
    kept = filters.outside_globs(kept, fixed.DEFAULT_EXCLUDE_GLOBS if globs is None else globs)
    return filters.text_only(kept, "document")


def document_report(documents: DataFrame, style: str = "markdown", options: ReportOptions = ReportOptions(),
                    references: DataFrame | None = None) -> DataFrame:
    """(part, relative_path, part_no, detail, text): table of contents by directory, then the
    sections; ordered by the first four columns. With ``references`` (rows of
    ``xref.cross_references``) and a depth that shows them, their lines follow each file: one row
    per line, so a file that everything imports is no bigger row than any other."""
    contents = toc.toc_by_directory(
        documents, style if style in ("markdown", "html") else "text", options.enhanced_summaries)
    contents = contents.select(
        F.lit(1).alias("part"), F.concat_ws("/", "directory", "file_name").alias("relative_path"),
        F.when(F.col("file_name") == "", 0).otherwise(1).alias("part_no"), F.lit("").alias("detail"),
        F.col("line").alias("text"))
    body = sections.document_sections(documents, style, options)
    report = contents.unionByName(
        body.select(F.lit(2).alias("part"), "relative_path", "part_no", F.lit("").alias("detail"), "text"))
    if references is None or not (options.cross_references and options.at_least("detailed")):
        return report
    lines = xref.reference_report(references, options.depth, style if style in ("markdown", "html") else "text")
    at = F.format_string("%010d/%010d", "line", "character")
    incoming = F.when(F.col("direction") == "references", "1").otherwise("2")
    heads = references.select("relative_path", "direction").distinct().select(
        "relative_path", F.concat(incoming, F.lit("/")).alias("detail"),
        F.when(F.col("direction") == "references", "References:").otherwise("Referenced By:").alias("text"))
    rows = lines.select("relative_path", F.concat_ws("/", incoming, "other", at).alias("detail"),
                        F.col("report_line").alias("text")).unionByName(heads)
    return report.unionByName(rows.select(
        F.lit(2).alias("part"), "relative_path", F.lit(2**31 - 1).alias("part_no"), "detail", "text"))
