"""Report sections: one row per file part, rendered by column expressions.

A report is the table of its parts ordered by (relative_path, part_no); it is written by
``sources.state.write_report`` and never held as one string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import fixed
from corpuscope.functions import code, paths
from corpuscope.functions import text as tx
from corpuscope.operators import lines as ln
from corpuscope.operators import symbols as sy
from corpuscope.options import ReportOptions

Text = str | Column


def _col(value: Text) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def joined(*pieces: Text) -> Column:
    return F.concat(*[_col(p) for p in pieces])


def block(*rows: Text | None) -> Column:
    """Rows joined by line feeds; a null row vanishes."""
    return F.concat_ws("\n", *[_col(r) for r in rows if r is not None])


def _present(value: Column, rendered: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", rendered)


# --- tree reports ---------------------------------------------------------------------------


def _with_analysis(files: DataFrame) -> DataFrame:
    """Add ``_analysis``: the symbol summary of Python files, a fixed remark for others."""
    is_python = F.col("language") == "python"
    scanned = sy.with_scan(files, F.when(is_python, F.col("content")))
    return scanned.withColumn("_analysis", F.when(is_python, sy.analysis_text(F.col("content"))).otherwise(
        "Unable to analyze file content")).withColumn(
        "_imports", sy.import_array(F.col("scan.imports"))).drop("scan", "symbols")


def _or_whole(chunks: Column) -> Column:
    """The chunks; for an empty file, which has none, one empty part."""
    return F.when(F.size(chunks) > 0, chunks).otherwise(ln.report_chunk_array(F.col("content"), 0))


def _tree_parts(files: DataFrame, budget: int) -> DataFrame:
    """One row per part. Texts over the line threshold are cut by lines, others by characters."""
    files = files.withColumn("_by_lines", ln.line_chunk_array(
        F.col("content"), threshold=fixed.LINE_CHUNK_THRESHOLD))
    chunks = F.when(F.size("_by_lines") > 0, F.col("_by_lines")).otherwise(
        _or_whole(ln.char_chunk_array(F.col("content"), budget)))
    note = F.when(F.size("_by_lines") > 0, F.format_string("File split into %d chunks", F.size("_by_lines")))
    return (
        files.withColumn("_chunk_note", note).withColumn("_chunks", chunks).drop("_by_lines", "content")
        .withColumn("part_count", F.size("_chunks"))
        .select("*", F.inline("_chunks")).drop("_chunks").withColumnRenamed("chunk_no", "part_no"))


def _tree_columns(files: DataFrame) -> DataFrame:
    files = files if "user_summary" in files.columns else files.withColumn(
        "user_summary", F.lit(None).cast("string"))
    return _with_analysis(files).withColumn(
        "_purpose", code.file_purpose(F.col("file_name"), F.col("ext"), F.col("content")))


def tree_markdown(files: DataFrame, budget: int = fixed.CHAR_CHUNK_SIZE) -> DataFrame:
    """(relative_path, part_no, text): one Markdown section per file part."""
    parts = _tree_parts(_tree_columns(files), budget)
    many = F.col("part_count") > 1
    part, count = F.col("part_no").cast("string"), F.col("part_count").cast("string")
    path = F.col("relative_path")
    anchor = F.concat_ws("-", tx.slug(path), F.when(many, joined("part-", part)))
    fence = "```"
    text = block(
        joined("\n## ", F.col("file_name"),
               F.when(many, joined(" (Part ", part, "/", count, ")")).otherwise(""), " {", anchor, "}"),
        "", "### File Purpose", F.coalesce(F.nullif("_purpose", F.lit("")), F.lit("General purpose file")), "",
        _present(F.nullif(F.col("directory"), F.lit(".")),
                 block("### Directory Context", paths.directory_name(path), "")),
        F.when(F.size("_imports") > 0, block(
            "### Dependencies", "This file depends on:", "\n",
            F.array_join(F.transform("_imports", lambda d: joined("- `", d, "`")), "\n"), "")),
        block(F.col("_analysis"), ""),
        block("#### Directory Hierarchy", joined("`", F.col("directory"), "`"), ""),
        "### Metadata", fence + "yaml", joined("path: ", path), joined("language: ", F.col("language")),
        joined("size: ", F.col("size").cast("string"), " bytes"),
        joined("last_modified: ", tx.iso_time(F.col("mtime"))), fence, "",
        F.when(F.col("_chunk_note").isNotNull(), block("#### Chunking Information", F.col("_chunk_note"), "")),
        _present(F.col("user_summary"), block("### User-Provided Summary", F.col("user_summary"), "")),
        "### Source Code",
        F.when(many, joined("# Chunk ", part, " of ", count)).otherwise(""),
        F.when(many, joined("# Lines ", F.col("start_line").cast("string"), "-", F.col("end_line").cast("string"))
               ).otherwise(""),
        F.when(many, F.lit("# " + "-" * 40)).otherwise(""),
        joined(fence, F.col("language"), "\n", tx.strip(F.col("content")), "\n" + fence), "",
        F.when(F.col("part_no") < F.col("part_count"), F.lit("---\n")),
    )
    return parts.select("relative_path", "part_no", text.alias("text"))


def file_id(path: Column) -> Column:
    """A stable id of a path for links."""
    return joined("file_", F.sha2(path.cast("binary"), 256))


def tree_html(files: DataFrame, extra_spacing: bool = True) -> DataFrame:
    """(relative_path, part_no, text): one HTML section per file."""
    rows = _tree_columns(files)
    language, path = F.col("language"), F.col("relative_path")

    def code_block(content: Column) -> Column:
        return block(joined('<pre><code class="', language, '">'), tx.html_escape(content), "</code></pre>")

    def numbered(chunk: Column) -> Column:
        return block(
            joined("<h4>Chunk ", chunk["chunk_no"].cast("string"), "</h4>"), code_block(chunk["content"]),
            "<br>" if extra_spacing else None)

    chunks = ln.line_chunk_array(F.col("content"), threshold=fixed.LINE_CHUNK_THRESHOLD)
    body = tx.let(chunks, lambda cut: F.when(
        F.size(cut) > 0, F.array_join(F.transform(cut, numbered), "\n")).otherwise(code_block(F.col("content"))))
    text = block(
        joined("<div class='file-header' id='", file_id(path), "'>"), joined("<h2>", path, "</h2>"),
        "<h3>File Purpose</h3>", joined("<p>", F.col("_purpose"), "</p>"),
        joined("<p><strong>Size:</strong> ", tx.size_label(F.col("size")), "</p>"),
        joined("<p><strong>Last Modified:</strong> ", tx.iso_time(F.col("mtime")), "</p>"),
        F.when(F.size("_imports") > 0, block(
            "<p><strong>Dependencies:</strong></p>", "<ul>",
            F.array_join(F.transform("_imports", lambda d: joined("<li>", d, "</li>")), "\n"), "</ul>")),
        "</div>", "<div class='file-content'>", body, "<div class='file-metadata'>", F.col("_analysis"),
        "</div>", "</div>", "<hr>" if extra_spacing else None)
    return rows.select("relative_path", F.lit(1).alias("part_no"), text.alias("text"))


def tree_html_toc(files: DataFrame) -> DataFrame:
    """List entries of the HTML table of contents, to stand before the sections."""
    path = F.col("relative_path")
    return files.select("relative_path", F.lit(0).alias("part_no"), joined(
        "<li><a href='#", file_id(path), "'>", path, "</a></li>").alias("text"))


# --- document reports --------------------------------------------------------------------------


def analysis_fields(content: Column, options: ReportOptions) -> dict[str, Column]:
    """The analysis the depth shows, and nothing else: a field that is not shown is never
    computed."""

    def listed(values: Column) -> Column:
        return F.nullif(F.array_join(values, ", "), F.lit(""))

    def referenced(pattern_kind: str) -> Column:
        kept = F.filter(code.raw_references(content), lambda r: r["type"] == pattern_kind)
        return listed(F.transform(kept, lambda r: r["file"]))

    def counted(label: str, value: Column, tail: str = "") -> Column:
        return joined(label, value.cast("string"), tail)

    fields: dict[str, Callable[[], Column]] = {
        "purpose": lambda: code.keyword_purpose(content),
        "frameworks": lambda: listed(code.frameworks(content)),
        "dependencies": lambda: listed(code.package_dependencies(content)),
        "imports": lambda: referenced("import"),
        "exports": lambda: referenced("export"),
        "complexity": lambda: joined(
            counted("Cognitive: ", code.cognitive(content)), counted(", Cyclomatic: ", code.cyclomatic(content)),
            counted(", Lines: ", tx.line_count(content))),
        "documentation": lambda: joined(
            counted("", code.comment_count(content), " comments, "),
            counted("", code.doc_comment_count(content), " JSDoc blocks")),
        "security": lambda: listed(F.concat(code.sensitive_flags(content), code.data_access_flags(content))),
    }
    return {name: fields[name]() for name in options.shown_fields()}


def _label(name: str) -> str:
    return name.capitalize()


def summary_rows(files: DataFrame, options: ReportOptions) -> DataFrame:
    """(relative_path, <shown fields>)."""
    fields = analysis_fields(F.col("content"), options)
    return files.select("relative_path", *[value.alias(name) for name, value in fields.items()])


def limited_key_points(points: Column, depth: str) -> Column:
    limit = fixed.KEY_POINT_LIMITS[depth]
    return points if limit is None else F.slice(points, 1, limit)


def key_point_lines(points: Column, options: ReportOptions, style: str) -> Column:
    """Key points as report lines. At full depth what follows `` - `` becomes sub-points."""
    bullet, sub = {"text": ("  • ", "    - "), "markdown": ("- ", "  - "), "html": ("<li>", "<li>")}[style]
    full = options.depth == "comprehensive"

    def nested(point: Column) -> Column:
        pieces = F.split(point, " - ")
        below = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: joined(sub, p, "</li>" if style == "html" else ""))
        if style == "html":
            inner = F.when(F.size(pieces) > 1, block("<ul>", F.array_join(below, "\n"), "</ul>"))
            return block(joined(bullet, F.get(pieces, 0)), inner, "</li>")
        return F.concat_ws("\n", joined(bullet, F.get(pieces, 0)), below)

    def plain(point: Column) -> Column:
        return joined(bullet, point, "</li>" if style == "html" else "")

    shown = limited_key_points(points, options.depth)
    return F.array_join(F.transform(shown, nested if full else plain), "\n")


def _insight(files: DataFrame, options: ReportOptions, style: str) -> Column | None:
    """The pass-through summary and key points, when the table has them."""
    has_summary, has_points = "ai_summary" in files.columns, "key_points" in files.columns
    if not (has_summary or has_points):
        return None
    summary = F.col("ai_summary") if has_summary else F.lit(None).cast("string")
    points = F.coalesce("key_points", F.array().cast("array<string>")) if has_points else F.array().cast("array<string>")
    listed = F.when(F.lit(options.depth != "minimal") & (F.size(points) > 0), key_point_lines(points, options, style))
    any_of = _present(summary, F.lit(1)).isNotNull() | (F.size(points) > 0)
    if style == "text":
        shape = block("", "AI Analysis", "-----------", _present(summary, joined("Summary: ", summary)),
                      F.when(listed.isNotNull(), block("Key Points:", listed)))
    elif style == "markdown":
        shape = block("<details><summary>AI Analysis</summary>\n", _present(summary, joined("**Summary**: ", summary, "\n")),
                      F.when(listed.isNotNull(), block("**Key Points**:", listed)), "\n</details>",
                      "" if options.extra_spacing else None)
    else:
        shape = block(
            '<details class="ai-analysis">', "<summary>AI Analysis</summary>", '<div class="analysis-content">',
            _present(summary, joined('<div class="ai-summary"><strong>Summary:</strong> ', summary, "</div>")),
            F.when(listed.isNotNull(), block(
                '<div class="key-points">', "<strong>Key Points:</strong>", "<ul>", listed, "</ul>", "</div>")),
            "</div>", "</details>")
    return F.when(any_of, shape)


def _document_parts(files: DataFrame, options: ReportOptions) -> DataFrame:
    fields = analysis_fields(F.col("content"), options)
    known = files.select("*", *[value.alias(f"_{name}") for name, value in fields.items()])
    cut = known.withColumn("_chunks", ln.report_chunk_array(F.col("content"), options.chunk_size))
    return cut.drop("content").withColumn("part_count", F.size("_chunks")).select(
        "*", F.inline("_chunks")).drop("_chunks").withColumnRenamed("chunk_no", "part_no")


def _shown(name: str, shape: Callable[[str, Column], Column], options: ReportOptions) -> Column | None:
    if name not in options.shown_fields():
        return None
    value = F.col(f"_{name}")
    return _present(value, shape(_label(name), value))


# The fields that follow the fixed metadata of a section; plain and HTML sections end with
# the exports.
_TEXT_FIELDS = ["purpose", "frameworks", "dependencies", "imports", "exports"]
_TABLE_FIELDS = [*_TEXT_FIELDS, "complexity", "documentation", "security"]


def _part_mark(style: str) -> Column:
    many = F.col("part_count") > 1
    place = joined(F.col("part_no").cast("string"), "/", F.col("part_count").cast("string"))
    return F.when(many, joined(" (Chunk ", place, ")")).otherwise("")


def _fenced(options: ReportOptions, content: Column) -> Column:
    label = paths.fence_label(F.col("language"), options.fence_labels)
    return joined("```", label, "\n", content, "\n```")


def document_plaintext(files: DataFrame, options: ReportOptions = ReportOptions()) -> DataFrame:
    """(relative_path, part_no, text): plain-text sections."""
    parts = _document_parts(files, options)
    many = F.col("part_count") > 1
    rule = "//" + fixed.CHUNK_SEPARATORS[options.separator]
    start, end = F.col("start_line").cast("string"), F.col("end_line").cast("string")
    content = F.col("content")
    text = block(
        joined("File: ", F.col("relative_path")), joined("Language: ", F.col("language")), "",
        *[_shown(name, lambda label, value: joined(f"{label}: ", value), options) for name in _TEXT_FIELDS],
        _insight(files, options, "text"),
        "" if options.extra_spacing else None,
        F.when(many, block(
            rule, joined("// Chunk ", F.col("part_no").cast("string"), ": Lines ", start, "-", end), rule,
            "" if options.extra_spacing else None)),
        _fenced(options, content) if options.code_fences else content,
        "", "//" + fixed.SECTION_SEPARATORS[options.separator], "",
        "" if options.extra_spacing else None)
    return parts.select("relative_path", "part_no", text.alias("text"))


def document_markdown(files: DataFrame, options: ReportOptions = ReportOptions()) -> DataFrame:
    """(relative_path, part_no, text): Markdown sections with a metadata table."""
    parts = _document_parts(files, options)
    many, path = F.col("part_count") > 1, F.col("relative_path")
    start, end = F.col("start_line").cast("string"), F.col("end_line").cast("string")

    def table_row(label: str, value: Text) -> Column:
        return joined(f"| {label} | ", value, " |")

    opened = F.when(F.col("part_no") == 1, F.lit("<details open>")).otherwise("<details>")
    chunk = block(
        joined(opened, "<summary>Chunk ", F.col("part_no").cast("string"), ": Lines ", start, "-", end, "</summary>"),
        "" if options.extra_spacing else None, _fenced(options, F.col("content")),
        "" if options.extra_spacing else None, "</details>")
    text = block(
        joined("## ", F.col("file_name"), _part_mark("markdown"), " {", F.col("directory"), "}"), "",
        "<details>", "<summary>File Metadata</summary>", "", "| Property | Value |", "|----------|--------|",
        table_row("Path", joined("`", path, "`")), table_row("Language", F.col("language")),
        table_row("Size", joined(F.col("size").cast("string"), " bytes")),
        table_row("Last Modified", tx.iso_time(F.col("mtime"))),
        *[_shown(name, table_row, options) for name in _TABLE_FIELDS],
        "\n</details>", "" if options.extra_spacing else None,
        _insight(files, options, "markdown"),
        F.when(many, chunk).otherwise(_fenced(options, F.col("content"))),
        "" if options.extra_spacing else None)
    return parts.select("relative_path", "part_no", text.alias("text"))


def document_html(files: DataFrame, options: ReportOptions = ReportOptions()) -> DataFrame:
    """(relative_path, part_no, text): HTML sections."""
    parts = _document_parts(files, options)
    path, spaced = F.col("relative_path"), " extra-spacing" if options.extra_spacing else ""

    def table_row(label: str, value: Text) -> Column:
        return joined(f"<tr><td>{label}</td><td>", value, "</td></tr>")

    text = block(
        f'<div class="file-section{spaced}">',
        joined("<h2>", F.col("file_name"), _part_mark("html"), ' <span class="file-path">', F.col("directory"), "</span></h2>"),
        '<div class="file-metadata">', "<details>", "<summary>File Metadata</summary>", "<table>",
        "<tr><th>Property</th><th>Value</th></tr>",
        table_row("Path", joined("<code>", path, "</code>")), table_row("Language", F.col("language")),
        table_row("Size", joined(F.col("size").cast("string"), " bytes")),
        table_row("Last Modified", tx.iso_time(F.col("mtime"))),
        *[_shown(name, table_row, options) for name in _TEXT_FIELDS],
        "</table>", "</details>", "</div>", _insight(files, options, "html"),
        joined(f'<div class="code-block{spaced}"><pre><code class="language-', F.col("language"), '">',
               tx.html_escape(F.col("content"), "document"), "</code></pre></div>"),
        "</div>", "<hr>", "" if options.extra_spacing else None)
    return parts.select("relative_path", "part_no", text.alias("text"))


_DOCUMENT_STYLES = {"markdown": document_markdown, "html": document_html}


def document_sections(files: DataFrame, style: str, options: ReportOptions = ReportOptions()) -> DataFrame:
    """Sections in the named style; any other name is plain text."""
    return _DOCUMENT_STYLES.get(style.lower(), document_plaintext)(files, options)


def tree_sections(files: DataFrame, style: str = "markdown", budget: int = fixed.CHAR_CHUNK_SIZE,
                  extra_spacing: bool = True) -> DataFrame:
    return tree_html(files, extra_spacing) if style.lower() == "html" else tree_markdown(files, budget)


def overview_sections(files: DataFrame, options: ReportOptions = ReportOptions(),
                      enable_chunking: bool = False) -> DataFrame:
    """(relative_path, part_no, text): short sections of the open documents: a metadata block
    and the fenced text. With chunking, texts of more characters than the chunk size are cut
    every that many lines."""
    content = F.col("content")
    known = files.withColumn("_frameworks", F.nullif(F.array_join(code.frameworks(content), ", "), F.lit("")))
    whole = F.array(F.struct(F.lit(1).alias("n"), F.lit(1).alias("of"), content.alias("piece")))
    cut = whole
    if enable_chunking:
        long_text = tx.let(
            ln.line_chunk_array(content, options.chunk_size, None, "document"),
            lambda c: F.transform(c, lambda one: F.struct(
                one["chunk_no"].alias("n"), F.size(c).alias("of"), one["content"].alias("piece"))))
        cut = F.when(F.length(content) > options.chunk_size, long_text).otherwise(whole)
    rows = known.withColumn("_cut", cut).drop("content").select("*", F.inline("_cut"))
    custom = [F.lit(x) for pair in options.fence_labels.items() for x in pair]
    language = F.col("language")
    label = F.coalesce(F.try_element_at(F.create_map(*custom), language), language) if custom else language
    summary = F.col("ai_summary") if "ai_summary" in files.columns else F.lit(None).cast("string")
    head = F.when(F.col("n") == 1, block(
        joined("\n## ", F.col("relative_path")),
        *([block("```yaml", joined("language: ", language),
                 joined("size: ", tx.size_label(F.col("size"), "document")),
                 joined("frameworks: ", F.col("_frameworks")), joined("summary: ", summary), "```")]
          if options.enhanced_summaries else [])))
    mark = F.when(F.col("of") > 1, F.format_string(" (Chunk %d/%d)", "n", "of")).otherwise("")
    text = block(head, joined("```", label, mark, "\n", F.col("piece"), "\n```",
                              "\n" if options.extra_spacing else ""))
    return rows.select("relative_path", F.col("n").alias("part_no"), text.alias("text"))
