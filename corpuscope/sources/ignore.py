"""Ignore rules from an ignore file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope.functions import globs
from corpuscope.functions import text as tx


def _shell_regex(pattern: Column) -> Column:
    """The regular expression of a shell glob, as column expression (balanced classes kept)."""
    text = F.regexp_replace(pattern, r"([\\.^$|+(){}])", r"\\$1")
    text = F.regexp_replace(text, r"\[(?![^\[\]]+\])", r"\\[")
    text = F.replace(text, F.lit("[!"), F.lit("[^"))
    text = F.regexp_replace(text, r"\*+", r"[\\s\\S]*")
    return F.concat(F.lit("^"), F.replace(text, F.lit("?"), F.lit(r"[\s\S]")), F.lit("$"))


def rules_from_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Rule lines to (…, pattern, regex): blanks and comments dropped, outer slashes removed, a
    bare name also covers what lies below it, other patterns match at any depth."""
    trimmed = lines.withColumn("_line", tx.strip(F.col(text))).filter(
        (F.col("_line") != "") & ~F.col("_line").startswith("#"))
    plain = F.rtrim(F.col("_line"), F.lit("/"))
    plain = F.when(plain.startswith("/"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain)
    return (
        trimmed.withColumn("_plain", plain)
        .withColumn("pattern", F.explode(
            F.when(F.col("_plain").startswith("*"), F.array("_plain"))
            .when(~F.contains("_plain", F.lit("/")), F.array(F.concat("_plain", F.lit("/**")), "_plain"))
            .when(F.col("_plain").startswith("/"), F.array("_plain"))
            .otherwise(F.array(F.concat(F.lit("**/"), "_plain")))))
        .withColumn("regex", _shell_regex(F.col("pattern")))
        .drop("_line", "_plain", text))


def _ignore_text(spark: SparkSession, root: str, name: str) -> str:
    """The one ignore file at the root, whatever its size: its rules become an expression, so they are needed whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return ""
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def pattern_list(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """Patterns of the ignore file at the root, for a filter expression; empty without one."""
    return globs.ignore_patterns(_ignore_text(spark, root, name).splitlines())


def read_rules(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """(pattern, regex) of the ignore file at the root; empty when there is none."""
    lines = [(line,) for line in _ignore_text(spark, root, name).splitlines()]
    return rules_from_lines(spark.createDataFrame(lines, "text string"))
