"""Python symbols, decorators, annotations and imports, by line rules: no syntax tree. As tables they come from
windows over lines (``blocks``); report sections, which need them beside the content of their file, take them from a scan inside
the row, so that no content is shuffled. A text that is not valid Python yields whatever lines look like symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.functions import pysource
from corpuscope.functions import text as tx
from corpuscope.operators import blocks
from corpuscope.operators import lines as ln


def adjusted_lines(leading: Column, symbol: Column) -> Column:
    """struct(start, end): leading blank lines of the text are not counted, and a definition
    after blank lines is moved to two lines below the text before it, with end = start + 1."""
    shifted = symbol["start_line"] - leading
    moves = (shifted > 1) & (symbol["start_line"] - 1 > symbol["line_before"])
    start = F.when(moves, symbol["line_before"] - leading + 2).otherwise(shifted)
    return F.struct(
        start.cast("int").alias("start"),
        F.when(moves, start + 1).otherwise(symbol["end_line"] - leading).cast("int").alias("end"))


# One annotation: a name with up to four levels of brackets, or a quoted name.
_INNER = r"\[[^\[\]]*\]"
for _ in range(3):
    _INNER = rf"\[(?:[^\[\]]|{_INNER})*\]"
_TYPE = rf"""(?:\w+(?:{_INNER})?|'[^']*'|"[^"]*")"""


def _plain_type(text: Column) -> Column:
    packed = F.regexp_replace(text, r"""[\s'"]+""", "")
    return F.replace(packed, F.lit(","), F.lit(", "))


def annotation_array(signature: Column) -> Column:
    """``name: Type`` of positional parameters and ``return -> Type``, for names, constants and
    subscripts."""
    positional = F.regexp_replace(signature, r"[(,]\s*\*[\s\S]*$", ")")
    pattern = rf"[(,]\s*(\w+)\s*:\s*({_TYPE})\s*(?=[,)=])"
    arguments = F.zip_with(
        F.regexp_extract_all(positional, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(positional, F.lit(pattern), F.lit(2)),
        lambda name, kind: F.when(~kind.rlike(r"[.|{}()]"), F.concat(name, F.lit(": "), _plain_type(kind))))
    returned = F.regexp_extract(signature, rf"\)\s*->\s*({_TYPE})\s*:", 1)
    result = F.when((returned != "") & ~returned.rlike(r"[.|{}()]"),
                    F.concat(F.lit("return -> "), _plain_type(returned)))
    return F.when(signature.startswith("def"), F.array_compact(F.concat(arguments, F.array(result)))
                  ).otherwise(F.array().cast("array<string>"))


def decorator_label(text: Column) -> Column:
    """``@name``, ``@a.b`` or ``@name(constants and names)``; null for other calls."""
    arguments = F.filter(
        F.transform(F.split(F.regexp_extract(text, r"^@\w+\((.*)\)$", 1), ","), tx.strip),
        lambda a: a.rlike(r"""^(?:\w+|\d+\.\d+|'[^']*'|"[^"]*")$"""))
    shown = F.array_join(F.transform(arguments, lambda a: F.btrim(a, F.lit("'\""))), ", ")
    name = F.regexp_extract(text, r"^(@\w+)", 1)
    return (
        F.when(text.rlike(r"^@\w+(?:\.\w+)*$"), text)
        .when(text.rlike(r"^@\w+\(.*\)$"),
              F.when(F.size(arguments) > 0, F.concat(name, F.lit("("), shown, F.lit(")"))).otherwise(name)))


def import_array(statements: Column) -> Column:
    """Sorted distinct imported modules: the top-level name, the full path below ``config``,
    and the names of ``from . import``."""

    def names(text: Column) -> Column:
        listed = F.transform(
            F.split(F.translate(text, "()", ""), ","),
            lambda n: F.regexp_replace(tx.strip(n), r"\s+as\s+\w+$", ""))
        return F.filter(listed, lambda n: n != "")

    def imported(code: Column) -> Column:
        plain = F.transform(
            names(F.regexp_extract(code, r"^import\s+(.*)$", 1)),
            lambda n: F.when(n.startswith("config."), n).otherwise(F.substring_index(n, ".", 1)))
        module = F.regexp_extract(code, r"^from\s+\.*\s*([\w.]*)\s*import\b", 1)
        objects = names(F.regexp_extract(code, r"^from\s+[\w.\s]*?\bimport\s*(.*)$", 1))
        relative = code.rlike(r"^from\s+\.+\s*import\b")
        of_module = F.when(relative, objects).when(
            module == "config", F.transform(objects, lambda n: F.concat(F.lit("config."), n))
        ).otherwise(F.array(F.substring_index(module, ".", 1)))
        return F.when(code.rlike(r"^import\s"), plain).when(
            code.rlike(r"^from\s+[\w.\s]*\bimport\b"), of_module).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(statements, imported))))


def with_scan(files: DataFrame, content: Column | None = None) -> DataFrame:
    """Add ``scan`` and ``symbols`` (the listed ones). Rows whose content is null cost nothing."""
    content = F.col("content") if content is None else content
    return files.withColumn("scan", pysource.scanned(content)).withColumn(
        "symbols", F.filter("scan.symbols", lambda s: s["listed"]))


def python_files(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("relative_path").rlike(r"\.pyw?$"))


def listed(files: DataFrame) -> DataFrame:
    """The listed symbols of Python files, one row each (``blocks.definitions``)."""
    return blocks.definitions(blocks.statements(python_files(files))).filter("listed")


def symbols(files: DataFrame) -> DataFrame:
    """(relative_path, kind, name, parent, start_line, end_line) of Python files."""
    return listed(files).select("relative_path", "kind", "name", "parent", "start_line", "end_line")


def adjusted_symbols(files: DataFrame) -> DataFrame:
    """Symbols with their line range counted without leading blank lines."""
    place = F.struct("start_line", "end_line", "line_before")
    return listed(files).withColumn("lines", adjusted_lines(F.col("leading"), place)).select(
        "relative_path", "kind", "name", "parent",
        F.col("lines.start").alias("start_line"), F.col("lines.end").alias("end_line"))


def annotations(files: DataFrame) -> DataFrame:
    """(relative_path, category, label): distinct decorators and type annotations per file."""
    rows = blocks.definitions(blocks.with_decorators(blocks.statements(python_files(files)))).filter("listed")

    def labelled(category: str, labels: Column) -> Column:
        return F.transform(labels, lambda label: F.struct(F.lit(category).alias("category"), label.alias("label")))

    decorators = F.array_compact(F.transform("decorators", decorator_label))
    return rows.select("relative_path", F.inline(F.concat(
        labelled("decorator", decorators), labelled("annotation", annotation_array(F.col("signature")))))).distinct()


def decorators_of(symbols: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(
        symbols, lambda s: F.transform(s["decorators"], decorator_label))))))


def annotations_of(symbols: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(
        symbols, lambda s: annotation_array(s["signature"])))))


def dependencies(files: DataFrame) -> DataFrame:
    """(relative_path, dependency) of Python files."""
    found = blocks.imports(blocks.statements(python_files(files)))
    return found.select("relative_path", F.explode(import_array(F.array("code"))).alias("dependency")).distinct()


def analysis_text(content: Column) -> Column:
    """The per-file summary of a scanned row: classes, functions, nested functions, decorators,
    annotations, marked comments and imports, in this order; absent parts are left out."""
    symbols, leading = F.col("symbols"), F.col("scan.leading")

    def listing(kind: str) -> Column:
        shown = F.transform(
            F.filter(symbols, lambda s: s["kind"] == kind),
            lambda s: tx.let(
                adjusted_lines(leading, s),
                lambda at: F.struct(
                    F.when(F.lit(kind == "nested"), F.concat_ws(" -> ", s["parent"], s["name"])
                           ).otherwise(s["name"]).alias("name"),
                    at["start"].alias("start"), at["end"].alias("end"))))
        labels = F.transform(F.array_sort(shown), lambda s: F.format_string(
            "%s (Lines %d-%d)", s["name"], s["start"], s["end"]))
        return F.array_join(labels, ", ")

    marks = F.transform(ln.todo_array(content), lambda t: F.format_string(
        "%s (Line %d): %s", t["kind"], t["line_no"], t["note"]))
    parts = {
        "Classes Defined": listing("class"),
        "Primary Functions": listing("function"),
        "Nested Functions": listing("nested"),
        "Decorators Used": F.array_join(decorators_of(symbols), ", "),
        "Type Annotations": F.array_join(annotations_of(symbols), ", "),
        "Code Patterns": F.array_join(marks, ", "),
        "Key Dependencies": F.array_join(import_array(F.col("scan.imports")), ", "),
    }
    rows = [tx.let(value, _titled(title)) for title, value in parts.items()]
    return F.concat_ws("\n", F.lit("### Quick Analysis"), *rows)


def _titled(title: str):
    return lambda value: F.when(value != "", F.concat(F.lit(f"- **{title}:** "), value))


def analysis_summary(files: DataFrame) -> DataFrame:
    return with_scan(python_files(files)).select("relative_path", analysis_text(
        F.col("content")).alias("summary"))
