"""Columns derived from source code by substring and pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuscope import fixed
from corpuscope.functions import text as tx

# ASCII word boundaries spelled out: the meaning of \b for non-ASCII letters differs between
# Java releases.
_W = "[A-Za-z0-9_]"
_NOT_AFTER_WORD, _NOT_BEFORE_WORD = f"(?<!{_W})", f"(?!{_W})"
_AFTER_WORD, _BEFORE_WORD = f"(?<={_W})", f"(?={_W})"


def _words(words: list[str]) -> str:
    first = "".join(sorted({w[0] for w in words}))  # a cheap test before the look-behind
    return f"(?=[{first}]){_NOT_AFTER_WORD}(?:{'|'.join(words)}){_NOT_BEFORE_WORD}"


def _count(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(pattern))


# --- purpose, frameworks --------------------------------------------------------------


def keyword_purpose(content: Column) -> Column:
    has = content.contains
    return (
        F.when(has("test") | has("spec"), "Test file")
        .when(has("interface") | has("type "), "Type definitions")
        .when(has("component") | has("React"), "React component")
        .otherwise("Source file")
    )


def frameworks(content: Column) -> Column:
    found = [F.when(content.contains(mark), F.lit(name)) for mark, name in fixed.FRAMEWORK_MARKS]
    return F.array_compact(F.array(*found))


def language_info(language: Column, content: Column, framework_names: Column) -> Column:
    side = F.when(
        language.isin("typescript", "typescriptreact"),
        F.when(content.contains("use client"), "Client Component").otherwise("Server Component"),
    )
    used = F.when(
        F.size(framework_names) > 0,
        F.concat(F.lit("Frameworks: "), F.array_join(framework_names, ", ")),
    )
    return F.concat_ws(" | ", side, used)


# --- packages and raw references --------------------------------------------------------

IMPORT_FROM = r"""import [^\n\r]* from ['"]([^'"]+)['"]"""
REQUIRE = r"""require\(['"]([^'"]+)['"]\)"""
EXPORT_TO = r"""export [^\n\r]* to ['"]([^'"]+)['"]"""
EXPORT_FROM = r"""export [^\n\r]* from ['"]([^'"]+)['"]"""


def _all(content: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def package_dependencies(content: Column) -> Column:
    """Distinct package names of imports, then of ``require`` calls, in first-seen order."""
    return F.array_distinct(F.concat(_all(content, IMPORT_FROM, 1), _all(content, REQUIRE, 1)))


def raw_references(content: Column, export_to_only: bool = False) -> Column:
    """array<struct(file, type, context)>: imports first, then exports."""
    exports = [EXPORT_TO] if export_to_only else [EXPORT_TO, EXPORT_FROM]

    def found(pattern: str, kind: str) -> Column:
        return F.zip_with(
            _all(content, pattern, 1), _all(content, pattern, 0),
            lambda file, context: F.struct(
                file.alias("file"), F.lit(kind).alias("type"), context.alias("context")),
        )

    return F.concat(found(IMPORT_FROM, "import"), *[found(p, "export") for p in exports])


# --- metrics ----------------------------------------------------------------------------


def _count_if(hints: list[str], content: Column, pattern: str) -> Column:
    """Count a pattern only in texts that contain one of the plain texts it needs."""
    possible = content.contains(hints[0])
    for hint in hints[1:]:
        possible = possible | content.contains(hint)
    return F.when(possible, _count(content, pattern)).otherwise(0)


def cyclomatic(content: Column) -> Column:
    """One plus decision points. Operators count only between two word characters, and an
    ``else if`` counts next to its ``if``."""
    glued = f"{_AFTER_WORD}(?:&&|\\|\\||\\?){_BEFORE_WORD}"
    return (
        F.lit(1)
        + _count(content, _words(fixed.CYCLOMATIC_WORDS))
        + _count_if(["else if"], content, _words(["else if"]))
        + _count_if(["&&", "||", "?"], content, glued)
    )


def cognitive(content: Column) -> Column:
    """Control words plus every ``?``, ``&&`` and ``||``, in one pass."""
    return _count(content, _words(fixed.COGNITIVE_WORDS) + r"|\?|&&|\|\|")


def comment_count(content: Column) -> Column:
    return _count_if(["//"], content, r"//[^\n\r]*") + _count_if(["/*"], content, r"/\*[\s\S]*?\*/")


def doc_comment_count(content: Column) -> Column:
    return _count_if(["/**"], content, r"/\*\*[\s\S]*?\*/")


def fenced_block_count(content: Column) -> Column:
    return _count_if(["```"], content, r"```[\s\S]*?```")


CREDENTIAL_WORDS = ["password", "secret", "key", "token", "credential"]
API_KEY_WORDS = ["apikey", "api_key", "api-key"]
DATABASE_WORDS = ["database", "db.", "sql", "query"]
NETWORK_WORDS = ["fetch", "axios", "http", "request"]


def _mentions(lowered: Column, content: Column, words: list[str]) -> Column:
    """Any of the words, in any ASCII case. Plain search in the lowered text comes first; the
    pattern then rules out other letters that lower to ASCII ones."""
    possible = lowered.contains(words[0])
    for word in words[1:]:
        possible = possible | lowered.contains(word)
    return possible & content.rlike("(?i)" + "|".join(tx.regex_literal(w) for w in words))


def _flags(content: Column, named: dict[str, list[str]]) -> Column:
    return tx.let(F.lower(content), lambda lowered: F.array_compact(F.array(*[
        F.when(_mentions(lowered, content, words), name) for name, words in named.items()])))


def sensitive_flags(content: Column) -> Column:
    return _flags(content, {"potential credentials": CREDENTIAL_WORDS, "API key": API_KEY_WORDS})


def data_access_flags(content: Column) -> Column:
    return _flags(content, {"database access": DATABASE_WORDS, "network requests": NETWORK_WORDS})


# --- purpose from the leading text ------------------------------------------------------


def _first(values: Column) -> Column:
    return F.get(values, 0)


def _block_comment(all_lines: Column, at: Column, end: Column, marks: list[str]) -> Column:
    joined = F.array_join(F.slice(all_lines, at + 1, F.greatest(end - at, F.lit(0)).cast("int")), " ")
    for mark in marks:
        joined = F.replace(joined, F.lit(mark), F.lit(""))
    return tx.strip(joined)


def _leading_comment(content: Column, marks: list[str], line_comments: bool) -> Column:
    """The first comment opened within ten lines. A block runs to the first line of the text
    that closes one; a line comment counts only when it says something."""

    def within(found: Column) -> Column:
        all_lines, end = found["lines"], found["end"]  # end: 1-based, 0 when nothing closes

        def candidate(line: Column, at: Column) -> Column:
            block = F.when(end > 0, _block_comment(all_lines, at, end, marks))
            choice = F.when(line.contains("/*"), block)
            if line_comments:
                after = tx.strip(F.substring(line, F.instr(line, "//") + 2, F.length(line)))
                choice = choice.when(line.contains("//") & (after != ""), after)
            return choice

        return _first(F.array_compact(F.transform(F.slice(all_lines, 1, 10), candidate)))

    def with_end(all_lines: Column) -> Column:
        end = F.array_position(F.transform(all_lines, lambda p: p.contains("*/")), True)
        return tx.let(F.struct(all_lines.alias("lines"), end.alias("end")), within)

    return tx.let(tx.lines(content), with_end)


def _docstring(content: Column) -> Column:
    """First line of the string literal that opens a Python module, if any."""
    opening = r"^(?:[ \t]*(?:#[^\n]*)?\n)*[rRuU]?"
    body = F.coalesce(
        F.nullif(F.regexp_extract(content, opening + r'"""([\s\S]*?)"""', 1), F.lit("")),
        F.nullif(F.regexp_extract(content, opening + r"'''([\s\S]*?)'''", 1), F.lit("")),
        F.nullif(F.regexp_extract(content, opening + r'"([^"\n]+)"[ \t]*(?:[;#\n]|$)', 1), F.lit("")),
        F.nullif(F.regexp_extract(content, opening + r"'([^'\n]+)'[ \t]*(?:[;#\n]|$)", 1), F.lit("")),
    )
    return F.ltrim(_first(F.filter(tx.lines(body), lambda p: tx.strip(p) != "")))


def _markdown_title(content: Column) -> Column:
    head = F.slice(tx.lines(content), 1, 3)
    titles = F.filter(head, lambda p: p.startswith("# "))
    return tx.strip(F.substring(_first(titles), F.lit(3), F.length(_first(titles))))


def _html_comment(content: Column) -> Column:
    opens, closes = F.instr(content, "<!--"), F.instr(content, "-->")
    inside = F.substring(content, opens + 4, F.greatest(closes - opens - 4, F.lit(0)))
    return F.when((opens > 0) & (closes > 0), tx.strip(inside))


def _first_text(content: Column) -> Column:
    head = F.transform(F.slice(tx.lines(content), 1, 10), tx.strip)

    def says_something(p: Column) -> Column:
        plain = p != ""
        for prefix in fixed.COMMENT_PREFIXES:
            plain = plain & ~p.startswith(prefix)
        return plain

    shown = F.substring(_first(F.filter(head, says_something)), 1, 50)
    return F.concat(F.lit("Text file starting with: "), shown, F.lit("..."))


def file_purpose(name: Column, ext: Column, content: Column) -> Column:
    """Purpose by rule cascade: file name, leading comment by type, first text, extension.
    Content that is null (not decodable) is a binary file."""
    by_name = F.when(name.endswith(".vscodeignore"), fixed.VSCODEIGNORE_PURPOSE)
    for special, purpose in fixed.SPECIAL_PURPOSES.items():
        by_name = by_name.when(name == special, purpose)
    script_marks = ["/**", "*/", "*"]
    by_type = (
        F.when(ext.isin(".py", ".pyw"), _docstring(content))
        .when(ext.isin(".ts", ".js", ".tsx", ".jsx"), _leading_comment(content, script_marks, True))
        .when(ext.isin(".css", ".scss", ".less"), _leading_comment(content, ["/*", "*/", "*"], False))
        .when(ext == ".md", _markdown_title(content))
        .when(ext.isin(".html", ".htm"), _html_comment(content))
        .when(ext == ".svg", F.lit(fixed.SVG_PURPOSE))
    )
    by_extension = F.concat(F.upper(F.substring(ext, F.lit(2), F.length(ext))), F.lit(" file"))
    return F.when(content.isNull(), F.lit(fixed.BINARY_PURPOSE)).otherwise(
        F.coalesce(by_name, by_type, _first_text(content), by_extension))


# --- README ------------------------------------------------------------------------------


def readme_purpose(content: Column) -> Column:
    """First paragraph that is no heading and no fence, without Markdown marks; else the title
    with the rest of its line or the next line; else the title; else null."""
    paragraphs = F.filter(
        F.transform(F.split(content, "\n\n"), tx.strip),
        lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("```"),
    )
    plain = _first(paragraphs)
    for pattern in (r"\[([^\]]+)\]\([^)]+\)", r"[*_]{1,2}([^*_]+)[*_]{1,2}", r"`([^`]+)`"):
        plain = F.regexp_replace(plain, pattern, "$1")
    plain = tx.strip(F.replace(plain, F.lit("\n"), F.lit(" ")))

    has_title = content.rlike(r"(?m)^#\s+([^\n]+)$")
    title = tx.strip(F.regexp_extract(content, r"(?m)^#\s+([^\n]+)$", 1))

    def after_title(found: Column) -> Column:
        all_lines, title = found["lines"], found["title"]
        marked = F.concat(F.lit("# "), title)
        title_line = F.coalesce(_first(F.filter(all_lines, lambda p: p.startswith("# "))), F.lit(""))
        same_line = tx.strip(F.call_function("substring_index", title_line, marked, F.lit(-1)))
        at = F.array_position(F.transform(all_lines, lambda p: p.startswith(marked)), True)
        following = F.when(at > 0, F.get(all_lines, at.cast("int")))
        next_line = F.when(~following.startswith("#"), F.nullif(tx.strip(following), F.lit("")))
        more = F.coalesce(F.nullif(same_line, F.lit("")), next_line)
        return F.coalesce(F.concat(title, F.lit(" - "), more), title)

    from_title = F.when(
        has_title,
        tx.let(F.struct(tx.lines(content).alias("lines"), title.alias("title")), after_title))
    return F.coalesce(F.nullif(plain, F.lit("")), from_title)
