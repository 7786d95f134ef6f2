"""What changed between two runs or two snapshots. Paths are unique on each side, so the joins
have no hot key; they carry hashes, and contents move only for files that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session
from corpuscope.functions import text as tx

CHANGE_TYPES = ["added", "modified", "removed", "unchanged"]


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full comparison of two ``(relative_path, content_hash)`` tables, unchanged included."""
    before = old.select("relative_path", F.col("content_hash").alias("old_hash"), F.lit(1).alias("_old"))
    after = new.select("relative_path", F.col("content_hash").alias("new_hash"), F.lit(1).alias("_new"))
    return before.join(after, "relative_path", "full_outer").select(
        "relative_path",
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
        .otherwise("unchanged").alias("change_type"),
        "old_hash", "new_hash")


def track_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    return classify(old, new).filter(F.col("change_type") != "unchanged")


def change_counts(changes: DataFrame) -> DataFrame:
    """One row per change type, zero where there is none."""
    spark = changes.sparkSession
    kinds = spark.createDataFrame([(k,) for k in CHANGE_TYPES], "change_type string")
    counted = changes.groupBy("change_type").agg(F.count("*").alias("n"))
    return kinds.join(counted, "change_type", "left").select(
        "change_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def added_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("relative_path"), "relative_path", "left_anti").select("relative_path")


def removed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return added_paths(new, old)


def kept_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("relative_path").intersect(new.select("relative_path"))


# --- snapshots ---------------------------------------------------------------------------

ANALYSIS_FIELDS = ["frameworks", "dependencies", "references", "referenced_by"]


def _fingerprint(files: DataFrame, ignore_whitespace: bool, ignore_case: bool, side: str) -> DataFrame:
    text_key = tx.content_hash(tx.normalized(F.col("content"), ignore_whitespace, ignore_case))
    fields = [f for f in ANALYSIS_FIELDS if f in files.columns]
    analysis_key = F.lit(None).cast("string")
    if fields:
        arrays = F.to_json(F.struct(*[F.coalesce(F.col(f), F.array().cast(files.schema[f].dataType)).alias(f)
                                      for f in fields]))
        present = F.lit(False)
        for f in fields:
            present = present | F.col(f).isNotNull()
        analysis_key = F.when(present, F.sha2(arrays, 256))
    return files.select(
        "relative_path", text_key.alias(f"{side}_text"), analysis_key.alias(f"{side}_analysis"),
        F.lit(1).alias(f"{side}_seen"))


def compare_snapshots(
    old: DataFrame, new: DataFrame, ignore_whitespace: bool = True, ignore_case: bool = False,
) -> DataFrame:
    """(relative_path, change_type, content_changed, analysis_changed) of all paths. A file is
    modified when its normalised text or its analysis lists differ."""
    joined = _fingerprint(old, ignore_whitespace, ignore_case, "old").join(
        _fingerprint(new, ignore_whitespace, ignore_case, "new"), "relative_path", "full_outer")
    both = F.col("old_seen").isNotNull() & F.col("new_seen").isNotNull()
    text_differs = both & ~F.col("old_text").eqNullSafe(F.col("new_text"))
    analysis_differs = both & ~F.col("old_analysis").eqNullSafe(F.col("new_analysis"))
    return joined.select(
        "relative_path",
        F.when(F.col("old_seen").isNull(), "added").when(F.col("new_seen").isNull(), "removed")
        .when(text_differs | analysis_differs, "modified").otherwise("unchanged").alias("change_type"),
        text_differs.alias("content_changed"), analysis_differs.alias("analysis_changed"))


def diff_text(old: Column, new: Column, ignore_whitespace: bool = True, ignore_case: bool = False) -> Column:
    """Position by position: ``- old`` and ``+ new`` where lines differ, tails alone."""

    def pair(before: Column, after: Column) -> Column:
        same = tx.normalized(before, ignore_whitespace, ignore_case) == tx.normalized(
            after, ignore_whitespace, ignore_case)
        minus, plus = F.concat(F.lit("- "), before), F.concat(F.lit("+ "), after)
        return F.when(before.isNull(), plus).when(after.isNull(), minus).when(
            ~same, F.concat(minus, F.lit("\n"), plus))

    return F.array_join(F.array_compact(F.zip_with(tx.lines(old), tx.lines(new), pair)), "\n")


def line_diff(
    old: DataFrame, new: DataFrame, ignore_whitespace: bool = True, ignore_case: bool = False,
) -> DataFrame:
    """(relative_path, diff) of files whose text changed. Hashes find them first, so only their
    contents are joined, and the diff is built inside the row."""
    touched = session.written(compare_snapshots(
        old.select("relative_path", "content"), new.select("relative_path", "content"),
        ignore_whitespace, ignore_case,
    ).filter("content_changed").select("relative_path"), "touched")
    before = old.select("relative_path", F.col("content").alias("old_content")).join(
        touched, "relative_path", "left_semi")
    after = new.select("relative_path", F.col("content").alias("new_content")).join(
        touched, "relative_path", "left_semi")
    return before.join(after, "relative_path").select(
        "relative_path",
        diff_text(F.col("old_content"), F.col("new_content"), ignore_whitespace, ignore_case).alias("diff"))


# --- report --------------------------------------------------------------------------------

_HEADINGS = {"added": "Added Files", "modified": "Modified Files", "removed": "Removed Files"}


def change_report(changes: DataFrame, style: str = "markdown") -> DataFrame:
    """Report lines (section_no, row_no, relative_path, line), to be ordered by the first three.
    Every bullet is a row, so a section of any length is never one value."""
    spark = changes.sparkSession
    if style == "html":
        frame = [('<div class="changes-section">', 0), ("<h3>{}</h3>", 1), ("<ul>", 2), ("</ul>", 4), ("</div>", 5)]
        bullet = ("<li>", ")</li>")
    else:
        frame = [("### {}", 0), ("", 1), ("", 4)]
        bullet = ("- ", ")")
    headings = spark.createDataFrame(
        [(kind, at + 1, row, "", line.format(title))
         for at, (kind, title) in enumerate(_HEADINGS.items()) for line, row in frame],
        "change_type string, section_no int, row_no int, relative_path string, line string")
    shown = changes.filter(F.col("change_type").isin(*_HEADINGS))
    section = F.array_position(F.array(*[F.lit(k) for k in _HEADINGS]), F.col("change_type")).cast("int")
    bullets = shown.select(
        section.alias("section_no"), F.lit(3).alias("row_no"), "relative_path",
        F.concat(F.lit(bullet[0]), "relative_path", F.lit(" ("), "change_type", F.lit(bullet[1])).alias("line"))
    present = shown.select("change_type").distinct()
    return bullets.unionByName(headings.join(present, "change_type").drop("change_type"))
