"""Files from a directory tree, from page tables and from document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from corpuscope import fixed
from corpuscope.functions import code, paths
from corpuscope.functions import text as tx
from corpuscope.operators import filters, symbols


def scan_tree(spark: SparkSession, root: str, max_bytes: int | None = None,
              name_glob: str | None = None) -> DataFrame:
    """Every file below ``root``: (relative_path, size, mtime, bytes). The size limit is pushed
    to the scan, so a larger file is never read; without ``bytes`` no file is."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    found = reader.load(root)
    if max_bytes is not None:
        found = found.filter(F.col("length") <= max_bytes)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.select(
        F.substring("path", F.lit(len(base.rstrip("/")) + 2), F.length("path")).alias("relative_path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        F.col("content").alias("bytes"))


TOO_LARGE, UNDECODABLE = "too large", "not UTF-8"


def tagged(scanned: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Every scanned row with ``content`` and ``reject_reason``, in one pass: a file that is kept has no
    reason and a content, a rejected one a reason and no content. Null ``bytes`` (a file that was listed and
    not read) is decided by the size alone: too large, or an empty text."""
    as_text = F.coalesce(F.col("bytes").cast("string"), F.lit(""))
    reason = F.when(~F.is_valid_utf8(as_text), UNDECODABLE)
    if max_bytes is not None:
        reason = F.when(F.col("size") > max_bytes, TOO_LARGE).otherwise(reason)
    found = scanned.withColumn("reject_reason", reason)
    return found.withColumn("content", F.when(F.col("reject_reason").isNull(), as_text))


def scan_counts(rows: DataFrame, observation: Observation) -> DataFrame:
    """The tagged rows, counted on their way: ``listed``, ``kept``, ``too_large`` and ``undecodable`` are in
    ``observation.get`` after the first action, without a pass of their own."""
    reason = F.col("reject_reason")
    return rows.observe(
        observation, F.count(F.lit(1)).alias("listed"), F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason == TOO_LARGE).alias("too_large"), F.count_if(reason == UNDECODABLE).alias("undecodable"))


def kept_texts(rows: DataFrame) -> DataFrame:
    return rows.filter("reject_reason IS NULL").drop("reject_reason")


def rejected(rows: DataFrame) -> DataFrame:
    """(relative_path, size, mtime, reject_reason) of what was not kept."""
    return rows.filter("reject_reason IS NOT NULL").select("relative_path", "size", "mtime", "reject_reason")


def decoded(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text rows with ``content``, rejected rows). Nothing is lost: what is not UTF-8 is in
    the second table."""
    rows = tagged(scanned)
    return kept_texts(rows), rejected(rows).drop("reject_reason")


def described(files: DataFrame, dialect: str = "tree") -> DataFrame:
    """Add name, directory, extension, language and hash to (relative_path, content, ...). The
    hash is that of the bytes."""
    path = F.col("relative_path")
    hashed = F.sha2(F.col("bytes"), 256) if "bytes" in files.columns else tx.content_hash(F.col("content"))
    out = files.select(
        "*", paths.file_name(path).alias("file_name"), paths.directory(path).alias("directory"),
        paths.suffix(paths.file_name(path)).alias("ext"), paths.language(path, dialect).alias("language"),
        hashed.alias("content_hash"))
    return out.drop("bytes")


def kept_paths(files: DataFrame, ignore: list[str] | None = None, exclude_dirs: list[str] | None = None,
               max_bytes: int | None = fixed.MAX_FILE_BYTES) -> DataFrame:
    """The path filters of a tree scan, all before any content is looked at."""
    kept = filters.not_ignored(files)
    if ignore:
        kept = filters.outside_rules(kept, ignore)
    if exclude_dirs:
        kept = filters.outside_directories(kept, exclude_dirs)
    if max_bytes is not None:
        kept = filters.within_size(kept, max_bytes)
    return filters.text_only(kept.withColumn("_name", paths.file_name(F.col("relative_path"))),
                             name="_name").drop("_name")


def analysis_columns(content: Column) -> dict[str, Column]:
    """The columns of a document analysis; a job reads only those its report shows."""
    return {
        "purpose": code.keyword_purpose(content),
        "frameworks": code.frameworks(content),
        "dependencies": code.package_dependencies(content),
        "references": code.raw_references(content),
        "cognitive": code.cognitive(content),
        "cyclomatic": code.cyclomatic(content),
        "line_count": tx.line_count(content),
        "comments": code.comment_count(content),
        "doc_comments": code.doc_comment_count(content),
        "fenced_blocks": code.fenced_block_count(content),
        "sensitive": code.sensitive_flags(content),
        "data_access": code.data_access_flags(content),
    }


def with_metadata(files: DataFrame) -> DataFrame:
    """Tree-dialect metadata: purpose and, for Python, the sorted import list."""
    is_python = (F.col("language") == "python") & ~F.col("file_name").startswith(".")
    return symbols.with_scan(files, F.when(is_python, F.col("content"))).withColumn(
        "purpose", code.file_purpose(F.col("file_name"), F.col("ext"), F.col("content"))
    ).withColumn("dependencies", symbols.import_array(F.col("scan.imports"))).drop("scan", "symbols")


def dependency_lists(files: DataFrame) -> DataFrame:
    """(relative_path, dependencies): sorted distinct imports, Python or package imports."""
    return with_metadata(files).select("relative_path", F.when(
        F.col("language") == "python", F.col("dependencies")).otherwise(
        F.array_sort(code.package_dependencies(F.col("content")))).alias("dependencies"))
