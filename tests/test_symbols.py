import ast
import pathlib

from pyspark.sql import functions as F

from corpuscope.functions import code, pysource
from corpuscope.operators import blocks, lines, symbols
from corpuscope.plans import sections, toc

BLANKS = "\n\n\n\ndef function1():\n    pass\n\n\n\ndef function2():\n    pass"
NESTED = """
def outer_function():
    def inner_function1():
        pass
    def inner_function2():
        pass
    inner_function1()
"""
TYPES = """
from typing import List, Dict, Optional

@decorator
def complex_function(data: List[Dict[str, Optional[int]]]) -> None:
    pass
"""
MIXED = '''"""Module text.

def hidden(): pass
"""
import os, sys as s
import config.base
from config import (one,
    two as deux)
from . import sibling
from pkg.sub import thing

class A(Base):
    """doc
    class Inner: pass"""
    field: int = 3

    @staticmethod
    @cache(10, "x", flag=True)
    def method(self, a: int,
               b: Dict[str, List[int]] = {"k": [1]}, *rest: str, kw: bytes) -> Tuple[int, str]:
        text = "def no(): # not a comment"
        def local(x: "Quoted"): return x
        if a:
            def conditional(): pass
        return {
    "odd": 1
        }
    class Inner:
        def deep(self): pass

async def co():
    def in_co(): pass

if True:
    def branch(): pass

def last(x: np.array, y: int | None) -> "A": return \\
    1
'''


def listed_by_syntax(source):
    """The same listing rules over Python's own syntax tree."""
    out = []

    def visit(node, parent):
        if isinstance(node, ast.ClassDef) and parent is None:
            out.append(("class", node.name, None, node.lineno, node.end_lineno))
        elif isinstance(node, ast.FunctionDef):
            out.append(("nested" if parent else "function", node.name, parent, node.lineno, node.end_lineno))
        else:
            return
        for child in node.body:
            if isinstance(child, ast.FunctionDef):
                visit(child, node.name)

    for node in ast.parse(source).body:
        visit(node, None)
    return sorted(out, key=str)


def test_symbols_agree_with_the_syntax_tree(make_files):
    sources = {"blanks.py": BLANKS, "nested.py": NESTED, "types.py": TYPES, "mixed.py": MIXED}
    with open(symbols.__file__) as own:
        sources["own.py"] = own.read()
    with open(lines.__file__) as own:
        sources["lines.py"] = own.read()
    found = symbols.symbols(make_files(sources)).collect()
    for path, source in sources.items():
        mine = sorted([(r.kind, r.name, r.parent, r.start_line, r.end_line) for r in found if r.relative_path == path], key=str)
        assert mine == listed_by_syntax(source), path


ODD = {
    "empty.py": "", "blank.py": "\n  \n\n", "open.py": "x = (\n\ndef a():\n  pass", "tail.py": "@last\n@of_all",
    "quotes.py": 's = "a\\"b # c"\ndef f(): # d\n    return \'"""\'\n\n\n# end\n',
    "jump.py": "class A:\n    class B:\n        def c(self):\n            def d(): pass\n    def e(self): pass\nx = 1\n",
    "far.py": "if a:\n  @x\n  @y(1)\n  def f():\n    def g():\n      pass\n  z = 2\n@w\ndef h(a: int): pass",
    "split.py": "import a, \\\n  b\nfrom c import (d, # one\n  e)\ndef f(\n  a: int,\n) -> str:\n  '''t\ndef no():\n'''\n",
    "under.py": "a = {\n'k': [1,\n2]}\n\n\n\ndef f(): return {\n1:2}\n\n\n\n\nclass G: pass"}


def test_windows_agree_with_the_scan_of_a_row(make_files):
    """Blocks, statements and decorators from windows over lines are those of the scan that report sections use."""
    root = pathlib.Path(symbols.__file__).parent.parent
    sources = ODD | {"mixed.py": MIXED} | {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*.py"))[:40]}
    rows = blocks.statements(make_files(sources))
    kept = ["start_line", "end_line", "kind", "name", "parent", "listed", "line_before", "decorators", "signature"]
    found, imported = {}, {}
    for r in blocks.definitions(blocks.with_decorators(rows)).collect():
        found.setdefault(r.relative_path, []).append(([r[c] for c in kept], r.leading))
    for r in blocks.imports(rows).collect():
        imported.setdefault(r.relative_path, []).append(r.code)
    for path, source in sources.items():
        every, imports, leading = pysource.scan(source)
        assert sorted(found.get(path, []), key=str) == sorted((([s[c] for c in kept], leading) for s in every), key=str), path
        assert sorted(imported.get(path, [])) == sorted(imports), path


def test_windows_need_one_exchange_and_no_python(make_files):
    plan = blocks.definitions(blocks.with_decorators(blocks.statements(make_files({"a.py": MIXED}))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in text


def test_blank_lines_are_not_counted(make_files):
    rows = symbols.adjusted_symbols(make_files({"t.py": BLANKS})).collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [("function1", 1, 2), ("function2", 4, 5)]


def test_summary(make_files):
    files = make_files({"n.py": NESTED, "t.py": TYPES, "b.py": BLANKS, "p.py": "\n# Some code\n# More\n# TODO: Fix this\n# More\n# FIXME: Another issue\n"})
    text = {r.relative_path: r.summary for r in symbols.analysis_summary(files).collect()}
    assert "outer_function -> inner_function1" in text["n.py"] and "outer_function -> inner_function2" in text["n.py"]
    assert "data: List[Dict[str, Optional[int]]]" in text["t.py"] and "@decorator" in text["t.py"]
    assert "return -> None" in text["t.py"]
    assert "function1 (Lines 1-2), function2 (Lines 4-5)" in text["b.py"]
    assert text["p.py"] == "### Quick Analysis\n- **Code Patterns:** TODO (Line 4): Fix this, FIXME (Line 6): Another issue"


def test_summary_lists(make_files):
    source = "import os\nimport sys\n\ndef my_function():\n    pass\nclass MyClass:\n    pass"
    text = symbols.analysis_summary(make_files({"m.py": source})).first().summary
    assert "**Classes Defined:** MyClass" in text and "**Primary Functions:** my_function" in text
    assert "**Key Dependencies:** os, sys" in text


def test_dependencies(make_files):
    files = make_files({"m.py": MIXED, "main.py": "\nimport utils\nfrom config import settings\n",
                        "f1.py": "import file2", "f2.py": "import file1", "d.py": "import os\nfrom sys import path"})
    got = {}
    for row in symbols.dependencies(files).collect():
        got.setdefault(row.relative_path, set()).add(row.dependency)
    assert got == {
        "m.py": {"os", "sys", "config.base", "config.one", "config.two", "sibling", "pkg"},
        "main.py": {"utils", "config.settings"}, "f1.py": {"file2"}, "f2.py": {"file1"}, "d.py": {"os", "sys"}}


def test_annotations_and_decorators(make_files):
    got = {(r.category, r.label) for r in symbols.annotations(make_files({"m.py": MIXED})).collect()}
    assert got == {
        ("decorator", "@staticmethod"), ("decorator", "@cache(10, x)"),
        ("annotation", "a: int"), ("annotation", "b: Dict[str, List[int]]"), ("annotation", "return -> Tuple[int, str]"),
        ("annotation", "x: Quoted"), ("annotation", "return -> A")}


def test_toc_lists_symbols_of_all_depths(make_files):
    rows = toc.toc_entries(make_files({"m.py": MIXED}), with_symbols=True).orderBy("ord").collect()
    assert [r.title for r in rows] == [
        "m.py", "Class: A", "Class: Inner", "Function: branch", "Function: conditional", "Function: deep",
        "Function: in_co", "Function: last", "Function: local", "Function: method"]
    assert rows[0].summary == "Module text." and rows[1].anchor == "m-py-class-a"


def test_toc_of_a_long_file(make_files):
    rows = toc.toc_entries(make_files({"large_file.py": "\n".join(f"line {i}" for i in range(600))})).orderBy("ord").collect()
    assert rows[0].title == "large_file.py" and rows[1].title == "large_file.py (Part 1)" and len(rows) == 13
    assert rows[12].summary == "Lines 551-600"


def test_purposes(spark):
    cases = {
        ".gitignore": ("x", "Git ignore patterns for version control"),
        "LICENSE": ("x", "Project license information"),
        "a.vscodeignore": ("x", "VSCode extension packaging ignore patterns"),
        "doc.py": ('# c\n"""\n  This is a documented module.\nmore"""\nx = 1', "This is a documented module."),
        "one.py": ("'One line.'\nx = 1", "One line."),
        "none.py": ("# This file is for testing purposes.", "PY file"),
        "plain.py": ("\nimport utils\n", "Text file starting with: import utils..."),
        "b.ts": ("let a;\n/**\n * Hello\n * there\n */\n", "Hello   there"),
        "open.ts": ("/* never closed\n// said\n", "said"),
        "early.js": ("a */\n/* b", ""),
        "c.js": ("x = 1; // first\n// second", "first"),
        "d.css": ("/* the\n style */ p{}", "the  style  p{}"),
        "e.md": ("\n# Title \ntext", "Title"),
        "f.md": ("\n\n\n# Too late", "MD file"),
        "g.html": ("<p>x</p><!-- note --> <!-- b -->", "note"),
        "h.svg": ("<svg/>", "Vector graphics image file"),
        "i.txt": ("# a\n// b\n   \n" + "w" * 60, "Text file starting with: " + "w" * 50 + "..."),
        "Makefile": ("#\n", " file"),
    }
    from corpuscope.functions import paths
    rows = spark.createDataFrame([(k, c) for k, (c, _) in cases.items()] + [("bin.py", None)], "p string, content string")
    got = {r.p: r.v for r in rows.select("p", code.file_purpose(
        F.col("p"), paths.suffix(F.col("p")), F.col("content")).alias("v")).collect()}
    assert got.pop("bin.py") == "Binary file"
    assert got == {k: v for k, (_, v) in cases.items()}


def test_readme_purposes(spark):
    cases = {
        "# Source Directory\nContains core application logic.": "Source Directory - Contains core application logic.",
        "# T\n\nA [link](http://x) **bold** _it_ `c`\nnext": "A link bold it c next",
        "# T\n\n```\ncode\n```\n\n## S\n\nreal": "real", "# Only": "Only", "": None, "## no title": None,
        "#  Two spaces": "Two spaces - #  Two spaces",
        "# T\n# U": "T", "text first\n\n# T": "text first",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.v for r in rows.select("c", code.readme_purpose(F.col("c")).alias("v")).collect()}
    assert got == cases


def test_scores(spark):
    text = "if (a&&b) {} else if (c || d) x = y?z:w; switch case default for while catch éif ifx"
    rows = spark.createDataFrame([(text,)], "c string")
    row = rows.select(code.cyclomatic(F.col("c")).alias("a"), code.cognitive(F.col("c")).alias("b")).first()
    # if x3 (one after a non-ASCII letter), else if, case, default, for, while, catch, a&&b, y?z
    assert row.a == 1 + 3 + 1 + 5 + 2
    # if x3, else, switch, case, for, while, catch, &&, ||, ?
    assert row.b == 12


def test_flags_need_ascii_letters(spark):
    rows = spark.createDataFrame([("my TOKEN",), ("a KEY",), ("Api-Key db.x HTTP",), ("plain",)], "c string")
    got = [(r.a, r.b) for r in rows.select(
        code.sensitive_flags(F.col("c")).alias("a"), code.data_access_flags(F.col("c")).alias("b")).collect()]
    assert got == [([], []), (["potential credentials"], []),
                   (["potential credentials", "API key"], ["database access", "network requests"]), ([], [])]


def test_markdown_section(make_files):
    files = make_files({"src/test.py": 'import utils\nprint("test")'}).withColumn("user_summary", F.lit("This is a note."))
    text = sections.tree_markdown(files).first().text
    for wanted in ("### File Purpose", "### Dependencies", "- `utils`", "### Directory Context", "src", "```python",
                   'print("test")', "### User-Provided Summary", "This is a note.", "last_modified: 2025-01-16T00:00:00Z"):
        assert wanted in text
    html = sections.tree_html(files).first().text
    assert "<h3>File Purpose</h3>" in html and '<pre><code class="python">' in html and "&quot;test&quot;" in html
