"""Statements and blocks of Python texts as tables, by window functions over their lines.

A text is cut into lines inside its row, next to the same lines with strings covered by brackets and comments
left out. From there on only lines travel, once, by the path of their file; every later window and group has the
path among its keys, so Spark reuses that one exchange. A running bracket depth tells which lines belong to the
statement before them. The owner of a block is the nearest earlier statement that is indented less, and a block ends before
the next one that is indented as much or less: both are neighbours among the statements up to an indent, so statements are
repeated once per indent at which the file defines something. A file with k such indents has at least k * k / 2 bytes
of blanks, which bounds the copies; nothing is compared pair by pair.

Paths are unique, as in every table of files. Null texts have no lines. A text that is not valid Python yields whatever lines
look like definitions; one indented below a statement that opens no block counts as at the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.functions import text as tx

# Strings and comments. Possessive, so that the engine keeps no way back for each character.
_TOKENS = (
    r'"""[\s\S]*?"""|' r"'''[\s\S]*?'''|"
    r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|' r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'|"
    r"#[^\n]*+")
_DEFINITION = r"(?U)^(class|def)\s+(\w+)"
_KEPT = r"^(?:class\b|def\b|import\s|from\s|@)"  # statements whose words are of use later


def covered(content: Column) -> Column:
    """The text with strings as brackets around their line feeds, and without comments."""

    def cover(gap: Column, token: Column) -> Column:
        feeds = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
        hidden = F.concat(F.lit("("), F.repeat(F.lit("\n"), feeds), F.lit(")"))
        return F.concat(gap, F.when(token.isNull() | token.startswith("#"), "").otherwise(hidden))

    tokens = F.regexp_extract_all(content, F.lit(_TOKENS), F.lit(0))
    return F.array_join(F.zip_with(F.split(content, _TOKENS, -1), tokens, cover), "")


def code_lines(files: DataFrame) -> DataFrame:
    """(relative_path, line_no, leading, text, code, indent, balance, unfinished): the stripped line, the same
    without strings and comments, the brackets it leaves open, and whether it ends with a backslash. ``leading``
    counts the blank lines at the start of the file."""
    raw, covering = tx.lines(F.col("content")), tx.lines(covered(F.col("content")))
    filled = F.array_position(F.transform(raw, lambda line: tx.strip(line) != ""), F.lit(True))
    # What stands beside a generator is computed per generated row, so both columns come first.
    pairs = files.filter("content is not null").select(
        "relative_path", F.coalesce(F.nullif(filled, F.lit(0)) - 1, F.size(raw)).cast("int").alias("leading"),
        F.arrays_zip(raw.alias("raw"), covering.alias("covering")).alias("pairs")).select(
        "relative_path", "leading", F.posexplode("pairs").alias("at", "line"))
    covering, code = F.col("line.covering"), tx.strip(F.col("line.covering"))
    balance = F.length(F.translate(code, ")]}", "")) - F.length(F.translate(code, "([{", ""))
    return pairs.select(
        "relative_path", (F.col("at") + 1).alias("line_no"), "leading", tx.strip(F.col("line.raw")).alias("text"),
        code.alias("code"), (F.length(covering) - F.length(F.ltrim(covering, F.lit(tx.WHITESPACE)))).alias("indent"),
        balance.alias("balance"), code.endswith("\\").alias("unfinished"))


def statements(files: DataFrame) -> DataFrame:
    """(relative_path, start_line, end_line, leading, line_before, indent, opens, code, text): lines joined by open
    brackets or a backslash are one statement. ``line_before`` is the last line with text before it, ``opens`` tells whether
    it ends with a colon. ``code`` and ``text`` are kept for definitions, imports and decorators."""
    ordered = Window.partitionBy("relative_path").orderBy("line_no")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # The depth never falls below zero: the sum of the balances above its lowest value so far.
    lines = code_lines(files).withColumn("_sum", F.sum("balance").over(so_far))
    lines = lines.withColumn("_depth", F.col("_sum") - F.min(F.least("_sum", F.lit(0))).over(so_far))
    lines = lines.withColumn("_joined", F.coalesce(
        F.lag((F.col("_depth") > 0) | F.col("unfinished")).over(ordered), F.lit(False)))
    starts = ~F.col("_joined") & (F.col("code") != "")
    filled = (F.col("text") != "") | F.col("_joined")
    lines = lines.withColumn("_starts", starts).withColumn(
        "line_before", F.coalesce(F.max(F.when(filled, F.col("line_no"))).over(earlier), F.lit(0))).withColumn(
        "_of", F.last(F.when(starts, F.struct("line_no", F.col("code").rlike(_KEPT).alias("kept"))), True).over(so_far))
    own = lines.filter("_starts or _joined")
    words = F.when(F.col("_of.kept"), F.struct("line_no", F.rtrim("code", F.lit("\\")).alias("code"), "text"))
    grouped = own.groupBy("relative_path", F.col("_of.line_no").alias("start_line")).agg(
        F.max(F.struct("line_no", F.col("code").endswith(":").alias("opens"))).alias("_last"),
        F.min(F.struct("line_no", "indent", "line_before", "leading")).alias("_first"),
        F.array_sort(F.collect_list(words)).alias("_words"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("_words", lambda w: w[name]), " ").alias(name)

    return grouped.select(
        "relative_path", "start_line", F.col("_last.line_no").alias("end_line"), "_first.leading", "_first.line_before",
        "_first.indent", "_last.opens", joined("code"), joined("text"))


def with_decorators(rows: DataFrame) -> DataFrame:
    """Statements with the texts of the decorators right before each; decorators themselves go."""
    earlier = Window.partitionBy("relative_path").orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    is_mark = F.col("code").startswith("@")
    run = rows.withColumn("_mark", is_mark).withColumn("_run", F.count(F.when(~is_mark, 1)).over(earlier))
    marks = F.array_sort(F.collect_list(F.when(F.col("_mark"), F.struct("start_line", "text"))).over(
        Window.partitionBy("relative_path", "_run")))
    return run.withColumn("decorators", F.transform(marks, lambda m: m["text"])).filter("not _mark").drop("_mark", "_run")


def definitions(rows: DataFrame) -> DataFrame:
    """(relative_path, start_line, end_line, kind, name, parent, listed, leading, line_before, signature) of all classes
    and functions among statements (``statements``, with all their columns). ``listed`` are classes and functions at the top, and
    functions directly in a listed symbol."""
    path = Window.partitionBy("relative_path")
    word = F.nullif(F.regexp_extract("code", _DEFINITION, 1), F.lit(""))
    rows = rows.withColumn("_word", word).withColumn(
        "_before", F.lag("end_line").over(path.orderBy("start_line"))).withColumn(
        "_file_end", F.max("end_line").over(path)).withColumn(
        "_indents", F.collect_set(F.when(F.col("_word").isNotNull(), F.col("indent"))).over(path))
    own = F.col("_word").isNotNull() & (F.col("_indent") == F.col("indent"))
    levels = rows.withColumn("_indent", F.explode(F.filter("_indents", lambda x: x >= F.col("indent")))).drop("_indents")
    levels = levels.withColumn("_own", own).withColumn("text", F.when(own, F.col("text")))
    among = Window.partitionBy("relative_path", "_indent").orderBy("start_line")
    name = F.when(F.col("_word").isNotNull(), F.regexp_extract("code", _DEFINITION, 2))
    outer = F.when(F.col("indent") < F.col("_indent"), F.struct(
        (F.col("opens") | F.col("_word").isNotNull()).alias("opens"), name.alias("name")))
    found = levels.withColumn("name", name).withColumn(
        "_owner", F.last(outer, True).over(among.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "end_line", F.coalesce(F.lead("_before").over(among), F.col("_file_end"))).filter("_own")
    top = ~F.coalesce(F.col("_owner.opens"), F.lit(False))
    # Below a block that is not listed nothing is: blocks nest, so the furthest end among those before tells.
    stray = ~top & ((F.col("_word") == "class") | F.col("_owner.name").isNull())
    hidden_to = F.max(F.when(stray, F.col("end_line"))).over(
        path.orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1))
    hidden = F.coalesce(hidden_to >= F.col("start_line"), F.lit(False))
    kind = F.when(F.col("_word") == "class", "class").when(top, "function").otherwise("nested")
    return found.withColumn("kind", kind).withColumn("parent", F.when(~top, F.col("_owner.name"))).withColumn(
        "listed", top | (~stray & ~hidden)).withColumnRenamed("text", "signature").drop(
        "_word", "_before", "_file_end", "_indent", "_own", "_owner", "code", "indent", "opens")


def imports(rows: DataFrame) -> DataFrame:
    """(relative_path, code): the import statements among statements."""
    return rows.filter(F.col("code").rlike("^(?:import|from) ") & ~F.col("opens")).select("relative_path", "code")
