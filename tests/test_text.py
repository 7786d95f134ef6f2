import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpuscope.functions import text as tx
from corpuscope.operators import lines


def greedy(text, budget):
    out, current, used = [], [], 0
    for line in (text[:-1] if text.endswith("\n") else text).split("\n") if text else []:
        if current and used + len(line) + 1 > budget:
            out.append("\n".join(current))
            current, used = [], 0
        current.append(line)
        used += len(line) + 1
    return out + (["\n".join(current)] if current else [])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé \n", max_size=80), min_size=1, max_size=30, unique=True), st.integers(1, 25))
def test_char_chunks_against_a_loop(spark, texts, budget):
    rows = spark.createDataFrame([(t, t) for t in texts], "relative_path string, content string")
    got = {t: [] for t in texts}
    for r in lines.char_chunks(rows, budget).orderBy("relative_path", "chunk_no").collect():
        got[r.relative_path].append((r.content, r.start_line, r.end_line))
    for text in texts:
        assert [c for c, _, _ in got[text]] == greedy(text, budget)
        whole = (text[:-1] if text.endswith("\n") else text).split("\n") if text else []
        assert [ln for _, a, b in got[text] for ln in whole[a - 1:b]] == whole


def test_no_budget_keeps_the_text(spark):
    rows = spark.createDataFrame([("a", "x\ny\n")], "relative_path string, content string")
    assert [r.content for r in lines.char_chunks(rows, 0).collect()] == ["x\ny\n"]


def test_line_chunks(make_files):
    files = make_files({"a.py": "\n".join(f"line {i}" for i in range(1000)), "b.py": "\n".join(f"line {i}" for i in range(600)),
                        "c.py": "\n".join("x" for _ in range(100)), "d.py": "\n".join("x" for _ in range(101))})
    rows = lines.line_chunks(files).collect()
    count = {p: [r for r in rows if r.relative_path == p] for p in ("a.py", "b.py", "c.py", "d.py")}
    assert [len(count[p]) for p in count] == [20, 12, 0, 3]
    first = next(r for r in count["a.py"] if r.chunk_no == 1)
    assert (first.start_line, first.end_line, first.chunk_count) == (1, 50, 20)
    assert next(r for r in count["d.py"] if r.chunk_no == 3).content == "x"
    joined = "\n".join(r.content for r in sorted(count["b.py"], key=lambda r: r.chunk_no))
    assert joined == "\n".join(f"line {i}" for i in range(600))


def test_report_chunks_drop_blank_ones(make_files):
    files = make_files({"a.ts": "a\nb\n\n\nc\n\n", "b.ts": "ab"})
    rows = lines.exploded(files, lines.report_chunk_array(F.col("content"), 2)).orderBy("relative_path", "chunk_no").collect()
    assert [(r.relative_path, r.chunk_no, r.start_line, r.content) for r in rows] == [
        ("a.ts", 1, 1, "a\nb"), ("a.ts", 2, 5, "c\n"), ("b.ts", 1, 1, "ab")]


def test_size_labels(spark):
    sizes = [0, 1, 1023, 1024, 1280, 1792, 1536, 1048576, 10 * 1024 ** 3, 5 * 1024 ** 4, 3 * 1024 ** 6]
    rows = spark.createDataFrame([(s,) for s in sizes], "n bigint")

    def tree(n):
        for unit in ["B", "KB", "MB", "GB", "TB"]:
            if n < 1024.0:
                return f"{n:.1f} {unit}"
            n /= 1024.0
        return f"{n:.1f} PB"

    got = [tuple(r) for r in rows.select("n", tx.size_label(F.col("n")), tx.size_label(F.col("n"), "document"),
                                         tx.size_label(F.col("n"), "compact")).collect()]
    assert [g[1] for g in got] == [tree(n) for n in sizes]
    assert [g[2] for g in got][3:7] == ["1.0 KB", "1.3 KB", "1.8 KB", "1.5 KB"]
    assert [g[2] for g in got][-2:] == ["5120.0 GB", "3221225472.0 GB"]
    assert [g[3] for g in got][:7] == ["0 B", "1 B", "1023 B", "1 KB", "1.25 KB", "1.75 KB", "1.5 KB"]


def test_scalars(spark):
    rows = spark.createDataFrame([("  A  B!\n\n c\td ", "<a href=\"x\">'&'</a>")], "a string, b string")
    row = rows.select(
        tx.slug(F.col("a")).alias("slug"), tx.normalized(F.col("a")).alias("n"), tx.normalized(F.col("a"), False, True).alias("l"),
        tx.html_escape(F.col("b")).alias("h"), tx.line_count(F.col("a")).alias("c"), tx.snippet(F.col("a")).alias("s"),
        tx.blank_lines_between(F.col("a"), F.lit(1), F.lit(3)).alias("between"),
        tx.tag_parts(F.lit("directory/core")).alias("t"), tx.dependency_parts(F.lit("a@1")).alias("d")).first()
    assert row.slug == "a-b-c-d" and row.n == "A B! c d" and row.l == "  a  b!\n\n c\td "
    assert row.h == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;" and row.c == 3
    assert row.s == "  A  B!\n c\td " and row.between == 1
    assert tuple(row.t) == ("directory", "core") and tuple(row.d) == ("a", "1")


def test_search(make_files):
    files = make_files({"a": "One two\nTWO three \nfour\n", "b": "nothing"})
    assert [(r.line_no, r.text) for r in lines.search_substring(files, "two").orderBy("line_no").collect()] == [
        (1, "One two"), (2, "TWO three")]
    assert lines.search_substring(files, "").count() == 0
    got = lines.search_regex(files, "t[wh]").orderBy("relative_path", "line_no").collect()
    assert [(r.relative_path, r.line_no) for r in got] == [("a", 1), ("a", 2), ("b", 1)]


def test_todo_wins_and_needs_a_comment(make_files):
    files = make_files({"a.py": "x = 1 # TODO: no\n  ## TODO: yes FIXME: x\n#FIXME:  later \n# TODO without colon"})
    assert [tuple(r)[1:] for r in lines.todo_items(files).collect()] == [(2, "TODO", "yes FIXME: x"), (3, "FIXME", "later")]


def test_words(make_files):
    got = {r.word: r.n for r in lines.word_counts(make_files({"a": " The the\tcat\n", "b": "cat THE"})).collect()}
    assert got == {"the": 3, "cat": 2}


def test_regex_literal():
    for raw in ["a.b", "x|y", "(z)", "[q]", "a-b", "db."]:
        assert re.fullmatch(tx.regex_literal(raw), raw)
