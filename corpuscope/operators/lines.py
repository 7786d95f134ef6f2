"""Lines, line search, chunks and words. Everything is exploded from its own row: no shuffle
but the one of the word count, whose partial counts collapse a frequent word per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import fixed
from corpuscope.functions import text as tx


def lines(files: DataFrame, dialect: str = "document") -> DataFrame:
    """(relative_path, line_no, text). The ``tree`` dialect has no empty line after a final
    line feed."""
    pieces = tx.whole_lines(F.col("content")) if dialect == "tree" else tx.lines(F.col("content"))
    return files.select("relative_path", F.posexplode(pieces).alias("line_no", "text")).withColumn(
        "line_no", F.col("line_no") + 1)


def search_regex(files: DataFrame, expression: str) -> DataFrame:
    """Every line that matches, in any case."""
    return lines(files).filter(F.col("text").rlike(f"(?iu){expression}"))


def search_substring(files: DataFrame, query: str) -> DataFrame:
    """Every line that contains the query, in any case, trimmed; an empty query finds nothing.
    Files without a hit are dropped before they are cut into lines."""
    wanted = query.lower()
    if not wanted:
        return lines(files.filter(F.lit(False)))
    if "\n" not in wanted:
        files = files.filter(F.lower("content").contains(wanted))
    return lines(files).filter(F.lower("text").contains(wanted)).withColumn(
        "text", tx.strip(F.col("text")))


def todo_array(content: Column) -> Column:
    """array<struct(line_no, kind, note)> of ``#`` comment lines with a mark; ``TODO:`` wins
    over ``FIXME:`` on one line."""

    def item(line: Column, at: Column) -> Column:
        comment = tx.strip(F.ltrim(line, F.lit(tx.WHITESPACE)))
        comment = F.when(comment.startswith("#"), tx.strip(F.ltrim(comment, F.lit("#"))))
        kind = F.when(comment.contains("TODO:"), "TODO").when(comment.contains("FIXME:"), "FIXME")
        mark = F.concat(kind, F.lit(":"))
        note = tx.strip(F.substring(comment, F.instr(comment, mark) + F.length(mark), F.length(comment)))
        return F.when(kind.isNotNull(), F.struct(
            (at + 1).alias("line_no"), kind.alias("kind"), note.alias("note")))

    found = F.array_compact(F.transform(tx.lines(content), item))
    empty = F.array().cast("array<struct<line_no:int,kind:string,note:string>>")
    return F.when(content.rlike("TODO:|FIXME:"), found).otherwise(empty)


def todo_items(files: DataFrame) -> DataFrame:
    return files.select("relative_path", F.inline(todo_array(F.col("content"))))


_CHUNK = "array<struct<chunk_no:int,start_line:int,end_line:int,content:string>>"


def line_chunk_array(
    content: Column, size: int = fixed.LINE_CHUNK_SIZE, threshold: int | None = None,
    dialect: str = "tree",
) -> Column:
    """Chunks of ``size`` lines, the last one short. With a threshold, texts of at most that
    many lines have no chunks."""

    def body(pieces: Column) -> Column:
        count = F.size(pieces)
        chunks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(count / F.lit(size)).cast("int") - 1, F.lit(0))),
            lambda i: F.struct(
                (i + 1).cast("int").alias("chunk_no"),
                (i * size + 1).cast("int").alias("start_line"),
                F.least((i + 1) * size, count).cast("int").alias("end_line"),
                F.array_join(F.slice(pieces, i * size + 1, F.lit(size)), "\n").alias("content"),
            )).cast(_CHUNK)
        enough = count > (threshold if threshold is not None else 0)
        return F.when(enough, chunks).otherwise(F.array().cast(_CHUNK))

    pieces = tx.whole_lines(content) if dialect == "tree" else tx.lines(content)
    return tx.let(pieces, body)


def char_chunk_array(content: Column, budget: int = fixed.CHAR_CHUNK_SIZE) -> Column:
    """Greedy chunks: lines are added until one more (and its line feed) would exceed the
    budget; a longer line stands alone. A budget of zero or less keeps the text whole.

    The fold carries only the line numbers at which chunks start; the texts are cut once."""
    if budget <= 0:
        whole = F.struct(
            F.lit(1).alias("chunk_no"), F.lit(1).alias("start_line"),
            F.size(tx.whole_lines(content)).alias("end_line"), content.alias("content"))
        return F.array(whole).cast(_CHUNK)

    def step(acc: Column, width: Column) -> Column:
        cut = (acc["used"] > 0) & (acc["used"] + width > budget)
        return F.struct(
            (acc["line"] + 1).alias("line"),
            F.when(cut, width).otherwise(acc["used"] + width).alias("used"),
            F.when(cut, F.concat(acc["cuts"], F.array(acc["line"]))).otherwise(acc["cuts"]).alias("cuts"),
        )

    def body(pieces: Column) -> Column:
        widths = F.transform(pieces, lambda p: F.length(p) + 1)
        zero = F.struct(
            F.lit(1).alias("line"), F.lit(0).alias("used"), F.array(F.lit(1)).alias("cuts"))
        cuts = F.aggregate(widths, zero, step, lambda acc: acc["cuts"])

        def chunks(starts: Column) -> Column:
            return F.transform(starts, lambda start, i: F.struct(
                (i + 1).alias("chunk_no"), start.alias("start_line"),
                (F.coalesce(F.get(starts, i + 1), F.size(pieces) + 1) - 1).alias("end_line"),
                F.array_join(F.slice(
                    pieces, start,
                    F.coalesce(F.get(starts, i + 1), F.size(pieces) + 1) - start), "\n").alias("content"),
            )).cast(_CHUNK)

        return F.when(F.size(pieces) > 0, tx.let(cuts, chunks)).otherwise(F.array().cast(_CHUNK))

    return tx.let(tx.whole_lines(content), body)


def exploded(files: DataFrame, chunks: Column) -> DataFrame:
    """(relative_path, chunk_no, chunk_count, start_line, end_line, content)."""
    return (
        files.select("relative_path", chunks.alias("chunks"))
        .select("relative_path", F.size("chunks").alias("chunk_count"), F.inline("chunks"))
        .select("relative_path", "chunk_no", "chunk_count", "start_line", "end_line", "content")
    )


def line_chunks(files: DataFrame, size: int = fixed.LINE_CHUNK_SIZE,
                threshold: int | None = fixed.LINE_CHUNK_THRESHOLD) -> DataFrame:
    return exploded(files, line_chunk_array(F.col("content"), size, threshold))


def char_chunks(files: DataFrame, budget: int = fixed.CHAR_CHUNK_SIZE) -> DataFrame:
    return exploded(files, char_chunk_array(F.col("content"), budget))


def report_chunk_array(content: Column, size: int) -> Column:
    """Chunks of the report formatters: texts shorter than ``size`` characters stay whole,
    longer ones are cut every ``size`` lines, and blank chunks are dropped."""
    if not size or size <= 0:
        return F.array(F.struct(
            F.lit(1).alias("chunk_no"), F.lit(1).alias("start_line"),
            tx.line_count(content).alias("end_line"), content.alias("content"))).cast(_CHUNK)
    cut = F.filter(
        line_chunk_array(content, size, None, "document"), lambda c: tx.strip(c["content"]) != "")
    renumbered = F.transform(cut, lambda c, i: F.struct(
        (i + 1).alias("chunk_no"), c["start_line"].alias("start_line"),
        c["end_line"].alias("end_line"), c["content"].alias("content"))).cast(_CHUNK)
    # A text with nothing but blank chunks is one part, so its file stays in the report.
    whole = (F.length(content) < size) | (F.size(cut) == 0)
    return F.when(whole, report_chunk_array(content, 0)).otherwise(renumbered)


def word_counts(files: DataFrame) -> DataFrame:
    words = F.explode(F.split(F.lower("content"), r"\s+"))
    return files.select(words.alias("word")).filter(F.col("word") != "").groupBy("word").agg(
        F.count("*").alias("n"))
