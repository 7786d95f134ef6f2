"""Tables of contents as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.functions import code, paths
from corpuscope.functions import text as tx
from corpuscope.operators import lines as ln
from corpuscope.operators import symbols as sy


def _entries(items: Column, heading: str, kind: str) -> Column:
    """Level-2 entries for sorted names."""
    path = F.col("relative_path")
    return F.transform(F.array_sort(items), lambda name: F.struct(
        F.concat(F.lit(f"{heading}: "), name).alias("title"), F.lit(2).alias("level"),
        tx.slug(F.concat(path, F.lit(f"-{kind}-"), name)).alias("anchor"),
        F.concat(F.lit(f"{heading} definition for "), name).alias("summary")))


def toc_entries(files: DataFrame, with_symbols: bool = False) -> DataFrame:
    """(relative_path, ord, title, level, anchor, summary): the file, its classes and functions
    at any depth (Python, on request), and its parts. Everything stays in the row of the file.
    Anchors come from the path, so files of the same name do not share one."""
    path, name = F.col("relative_path"), F.col("file_name")
    note = F.col("user_summary") if "user_summary" in files.columns else F.lit(None).cast("string")
    files = files.withColumn("_purpose", code.file_purpose(name, F.col("ext"), F.col("content"))).withColumn(
        "_chunks", F.transform(ln.line_chunk_array(F.col("content"), threshold=100), lambda c: F.struct(
            c["chunk_no"].alias("n"), c["start_line"].alias("a"), c["end_line"].alias("b"))))
    main = F.array(F.struct(
        name.alias("title"), F.lit(1).alias("level"), tx.slug(path).alias("anchor"),
        F.coalesce(F.nullif("_purpose", F.lit("")), note).alias("summary")))
    parts = F.transform("_chunks", lambda c: F.struct(
        F.format_string("%s (Part %d)", name, c["n"]).alias("title"), F.lit(2).alias("level"),
        tx.slug(F.concat(path, F.lit("-part-"), c["n"].cast("string"))).alias("anchor"),
        F.format_string("Lines %d-%d", c["a"], c["b"]).alias("summary")))
    groups = [main]
    if with_symbols:
        files = sy.with_scan(files, F.when(paths.language(path) == "python", F.col("content")))

        def names(is_class: bool) -> Column:
            wanted = F.filter("scan.symbols", lambda s: (s["kind"] == "class") == F.lit(is_class))
            return F.transform(wanted, lambda s: s["name"])

        groups += [_entries(names(True), "Class", "class"), _entries(names(False), "Function", "function")]
    return files.select(
        "relative_path", F.posexplode(F.concat(*groups, parts)).alias("ord", "entry")
    ).select("relative_path", "ord", "entry.*")


def _tag_names(tags: Column, of_directory: bool) -> Column:
    """Names of ``scope/name`` tags, those of directories or the others; null when none."""
    parts = F.transform(tags, tx.tag_parts)
    kept = F.filter(parts, lambda t: (t["scope"] == "directory") == F.lit(of_directory))
    return F.nullif(F.array_join(F.transform(kept, lambda t: t["name"]), ", "), F.lit(""))


def directory_headings(files: DataFrame, style: str) -> DataFrame:
    """One heading row per directory. In Markdown it names the directory tags of its first file."""
    if style == "markdown" and "tags" in files.columns:
        shown = files.groupBy("directory").agg(F.min_by("tags", "relative_path").alias("tags")).withColumn(
            "_tags", _tag_names(F.col("tags"), True))
    else:
        shown = files.select("directory").distinct().withColumn("_tags", F.lit(None).cast("string"))
    tag_note = F.when(F.col("_tags").isNotNull(), F.concat(F.lit(" *("), "_tags", F.lit(")*")))
    shapes = {
        "text": F.concat(F.lit("\n["), "directory", F.lit("]")),
        "markdown": F.concat_ws("", F.lit("<details open><summary>📁 "), "directory", F.lit("/"), tag_note,
                                F.lit("</summary>\n")),
        "html": F.concat(F.lit('<div class="directory"><h3>📁 '), "directory", F.lit("/</h3>")),
    }
    return shown.filter("directory <> '.'").select(
        "directory", F.lit("").alias("file_name"), shapes[style].alias("line"))


def _insight(files: DataFrame, style: str, indent: Column) -> Column:
    """The pass-through summary and key points under a file, when the table has them."""
    summary = F.col("ai_summary") if "ai_summary" in files.columns else F.lit(None).cast("string")
    points = F.coalesce("key_points", F.array().cast("array<string>")) if "key_points" in files.columns \
        else F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    before, head, bullet, after, tail = {
        "text": ("  Summary: ", "  Key Points:", "    • ", "", None),
        "markdown": ("  - ", "  <details><summary>Key Points</summary>\n", "    - ", "", "  </details>"),
        "html": ('<div class="ai-summary">', '<details class="key-points">\n<summary>Key Points</summary>\n<ul>',
                 "<li>", "</li>", "</ul>\n</details>"),
    }[style]
    end = F.lit("</div>") if style == "html" else F.lit("")
    listed = F.array_join(F.transform(points, lambda p: F.concat(indent, F.lit(bullet), p, F.lit(after))), "\n")
    return F.concat_ws(
        "\n", F.when(F.coalesce(summary, F.lit("")) != "", F.concat(indent, F.lit(before), summary, end)),
        F.when(F.size(points) > 0, F.concat_ws(
            "\n", F.concat(indent, F.lit(head)), listed, F.concat(indent, F.lit(tail)) if tail else null)))


def toc_by_directory(files: DataFrame, style: str = "text", enhanced: bool = True) -> DataFrame:
    """(directory, file_name, line), one heading row per directory and one row per file; ordered
    by (directory, file_name) they form the table of contents. A directory of any size stays a
    set of rows. Needs ``language`` and ``content``; shows ``tags``, ``ai_summary`` and
    ``key_points`` when there are such columns."""
    content, path = F.col("content"), F.col("relative_path")
    known = files.withColumn("_frameworks", code.frameworks(content)).withColumn(
        "_purpose", code.keyword_purpose(content))
    uses = F.when(F.size("_frameworks") > 0, F.concat(F.lit("Uses: "), F.array_join("_frameworks", ", ")))
    info = F.nullif(code.language_info(F.col("language"), content, F.col("_frameworks")), F.lit(""))
    indent = F.when((F.col("directory") == ".") | F.lit(style == "html"), "").otherwise("  ")
    insight = F.nullif(_insight(files, style, indent), F.lit("")) if enhanced else F.lit(None).cast("string")
    if style == "text":
        head = F.concat_ws("", indent, "file_name", F.when(info.isNotNull(), F.concat(F.lit(" ("), info, F.lit(")"))))
        about = F.concat(indent, F.lit("  "), F.concat_ws(" | ", F.concat(F.lit("Purpose: "), "_purpose"), uses))
        line = F.concat_ws("\n", head, about, insight) if enhanced else head
    elif style == "markdown":
        tagged = F.concat(F.lit("Tags: "), _tag_names(F.col("tags"), False)) if "tags" in files.columns \
            else F.lit(None).cast("string")
        line = F.concat_ws("\n", F.concat(
            indent, F.lit("- ["), "file_name", F.lit("](#"), tx.slug(path), F.lit(") *("),
            F.concat_ws(" | ", "_purpose", uses, tagged), F.lit(")* ")), insight)
    elif style == "html":
        note = F.when(info.isNotNull(), F.concat(F.lit(' <span class="lang-info">('), info, F.lit(")</span>")))
        meta = F.concat_ws(
            "\n", F.lit('<div class="file-meta">'),
            F.concat(F.lit('<div class="purpose">'), "_purpose", F.lit("</div>")),
            F.concat(F.lit('<div class="frameworks">'), uses, F.lit("</div>")), F.lit("</div>"))
        line = F.concat_ws(
            "\n", F.lit('<div class="file-entry">'),
            F.concat_ws("", F.lit("<code>"), "file_name", F.lit("</code>"), note),
            meta if enhanced else F.lit(None).cast("string"), insight, F.lit("</div>"))
    else:
        raise ValueError(f"unknown style: {style}")
    return directory_headings(files, style).unionByName(known.select("directory", "file_name", line.alias("line")))
