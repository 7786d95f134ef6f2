"""Statistics per directory, language and pattern. Counts are taken per task before they move,
so a directory or language with most of the files costs no more than any other; listings are
rows, not arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import fixed, session
from corpuscope.functions import code, paths, sensitive
from corpuscope.functions import text as tx
from corpuscope.operators import filters

ALL_LANGUAGES = "(all)"


def language_stats(files: DataFrame) -> DataFrame:
    """(language, n_files, n_bytes), with a row for the whole corpus."""
    return with_total(files.groupBy("language").agg(F.count("*").alias("n"), F.sum("size").alias("b")))


def with_total(per_language: DataFrame) -> DataFrame:
    """(language, n_files, n_bytes) of counts per language (language, n, b), and a row for the whole corpus."""
    return (
        per_language.rollup("language")  # over one row per language, not over the files
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"))
        .withColumn("language", F.coalesce("language", F.lit(ALL_LANGUAGES))))


def _listed(name: Column) -> Column:
    return ~name.startswith(".") & ~F.lower(name).isin(*fixed.UNLISTED_NAMES)


def _chain(directory: str) -> Column:
    """A directory, its ancestors and the root, nearest first."""
    inner = F.concat(F.array(directory), paths.ancestors(F.col(directory)), F.array(F.lit(".")))
    return F.when(F.col(directory) == ".", F.array(F.lit("."))).otherwise(inner)


def directories(files: DataFrame) -> DataFrame:
    """Every directory that holds a file at any depth, the root included."""
    direct = files.select(paths.directory(F.col("relative_path")).alias("directory")).distinct()
    return direct.select(F.explode(_chain("directory")).alias("directory")).distinct()


def directory_entries(files: DataFrame) -> DataFrame:
    """(directory, kind, name, size): listed text files and subdirectories, one row each."""
    path = F.col("relative_path")
    found = files.select(
        paths.directory(path).alias("directory"), F.lit("file").alias("kind"),
        paths.file_name(path).alias("name"), "size")
    shown = filters.text_only(found.filter(_listed(F.col("name"))), name="name")
    below = directories(files).filter("directory <> '.'").select(
        paths.directory(F.col("directory")).alias("directory"), F.lit("directory").alias("kind"),
        paths.file_name(F.col("directory")).alias("name"), F.lit(None).cast("long").alias("size"))
    return shown.unionByName(below.filter(_listed(F.col("name"))))


def directory_totals(files: DataFrame) -> DataFrame:
    """(directory, num_files, num_dirs, size, main_ext) of every directory, from one scan of the
    paths and four aggregations of shrinking size: per extension, per directory, every ancestor
    once, and subdirectories per parent. The most frequent extension wins, ties by name."""
    path = F.col("relative_path")
    named = files.select(
        paths.directory(path).alias("directory"), paths.file_name(path).alias("name"), "size"
    ).withColumn("ext", paths.suffix(F.col("name")))
    shown = _listed(F.col("name")) & ~F.col("ext").isin(*fixed.BINARY_EXTENSIONS["tree"])
    by_ext = named.groupBy("directory", "ext").agg(
        F.sum(F.when(shown, 1).otherwise(0)).alias("n"), F.sum(F.when(shown, F.col("size"))).alias("size"))
    own = by_ext.groupBy("directory").agg(
        F.sum("n").alias("num_files"), F.sum("size").alias("size"),
        F.min(F.when((F.col("n") > 0) & (F.col("ext") != ""), F.struct((-F.col("n")).alias("n"), "ext")))["ext"].alias("main_ext"))
    here = F.col("up") == 0
    every = own.select(F.posexplode(_chain("directory")).alias("up", "directory"), "num_files", "size", "main_ext").groupBy(
        "directory").agg(*[F.max(F.when(here, F.col(c))).alias(c) for c in ("num_files", "size", "main_ext")])
    totals = ["num_files", "size", "main_ext"]
    as_child = F.when(F.col("directory") != ".", F.struct(
        paths.directory(F.col("directory")).alias("directory"),
        F.when(_listed(paths.file_name(F.col("directory"))), 1).otherwise(0).alias("child"),
        *[F.lit(None).alias(c) for c in totals]))
    both = every.select(F.inline(F.array_compact(F.array(
        F.struct("directory", F.lit(0).alias("child"), *totals), as_child))))
    zero = F.lit(0).cast("long")
    return both.groupBy("directory").agg(
        F.coalesce(F.max("num_files"), zero).alias("num_files"), F.sum("child").alias("num_dirs"),
        F.coalesce(F.max("size"), zero).alias("size"), F.max("main_ext").alias("main_ext"))


def generated_purpose() -> Column:
    kind = F.concat_ws(" ", F.substring("main_ext", F.lit(2), F.length("main_ext")), F.lit("files"))
    text = F.concat(F.lit("Directory containing "), F.col("num_files").cast("string"), F.lit(" "), kind)
    more = F.when(F.col("num_dirs") > 0, F.concat(
        F.lit(" and "), F.col("num_dirs").cast("string"), F.lit(" subdirectories"))).otherwise("")
    return F.when(F.col("num_files") == 0, "Empty directory").otherwise(F.concat(text, more))


def readme_purposes(files: DataFrame) -> DataFrame:
    """(directory, readme) of the directories whose own README says something."""
    readmes = files.filter(paths.file_name(F.col("relative_path")) == "README.md")
    return readmes.select(
        paths.directory(F.col("relative_path")).alias("directory"),
        code.readme_purpose(F.col("content")).alias("readme")).filter("readme is not null")


def directory_purposes(files: DataFrame) -> DataFrame:
    """The purpose a directory gets from what it holds."""
    return directory_totals(files).select("directory", "main_ext", generated_purpose().alias("purpose"))


def directory_summary(files: DataFrame) -> DataFrame:
    """(directory, name, parent, purpose, num_files, num_dirs, size); a README's purpose comes
    first. The names are the rows of ``directory_entries``."""
    return directory_totals(files).join(readme_purposes(files), "directory", "left").select(
        "directory", paths.file_name(F.col("directory")).alias("name"),
        paths.directory_name(F.col("directory")).alias("parent"),
        F.coalesce("readme", generated_purpose()).alias("purpose"), "num_files", "num_dirs", "size")


def sensitive_matches(
    files: DataFrame,
    patterns: Iterable[sensitive.SensitivePattern] = tuple(sensitive.BUILT_IN_PATTERNS),
) -> DataFrame:
    return files.select("relative_path", F.inline(sensitive.found(F.col("content"), patterns)))


def sensitive_summary(
    files: DataFrame,
    patterns: Iterable[sensitive.SensitivePattern] = tuple(sensitive.BUILT_IN_PATTERNS),
) -> DataFrame:
    return sensitive_matches(files, patterns).groupBy("relative_path", "pattern_name").agg(
        F.count("*").alias("n"))


def summaries_from_notes(files: DataFrame) -> DataFrame:
    """(relative_path, user_summary) of files with a note: ``<file>.notes`` beside it, else
    ``.notes/<file>`` in its directory; the first that says something. One scan supplies files
    and notes, and every file has at most two notes."""
    path = F.col("relative_path")
    hidden = paths.directory_name(path) == ".notes"
    outer = paths.directory(paths.directory(path))
    beside = F.when(path.endswith(".notes"), F.struct(
        F.substring(path, F.lit(1), F.length(path) - len(".notes")).alias("target"), F.lit(0).alias("rank")))
    inside = F.when(hidden, F.struct(
        F.concat_ws("/", F.nullif(outer, F.lit(".")), paths.file_name(path)).alias("target"),
        F.lit(1).alias("rank")))
    notes = (
        files.filter(path.endswith(".notes") | hidden)
        .select(tx.strip(F.col("content")).alias("note"), F.inline(F.array_compact(F.array(beside, inside))))
        .filter("note <> ''")
        .groupBy("target").agg(F.min_by("note", "rank").alias("user_summary")))
    return files.select("relative_path").join(notes, path == F.col("target")).select(
        "relative_path", "user_summary")


def with_user_summaries(files: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Add ``user_summary``, by default from the notes among the files themselves."""
    notes = summaries_from_notes(files) if notes is None else notes
    return files.join(session.written(notes, "notes"), "relative_path", "left")
