from corpuscope.functions import code
from corpuscope.operators import xref
from pyspark.sql import functions as F

SOURCES = {
    "src/test.ts": "import { helper } from './utils';\nimport type { Other } from '../types'\nimport express from 'express';\n"
                   "const u = require('./utils'); import './side.css'\nimport * as all from \"./a\";\nimport def, { one, two as alias } from './deep/../b';",
    "src/utils.ts": "", "types.ts": "", "src/side.css": "", "src/utils.js": "", "src/b.tsx": "", "src/b.js": "",
    "src/a.ts": "import { b } from './b'", "src/c.ts": "x\n  import {\n  a,\n  b } from './a';import './a'\nimport('../../out')",
}


def test_edges_and_positions(make_files):
    rows = xref.import_edges(make_files(SOURCES)).filter("source = 'src/test.ts'").orderBy("line", "character").collect()
    assert [(r.import_path, r.line, r.character, r.symbol) for r in rows] == [
        ("./utils", 0, 0, "helper"), ("../types", 1, 0, "Other"), ("./utils", 3, 10, None), ("./side.css", 3, 30, None),
        ("./a", 4, 0, None), ("./deep/../b", 5, 0, "one, two as alias")]


def test_resolution_prefers_extensions_in_order(make_files):
    files = make_files(SOURCES)
    edges = xref.resolve_imports(xref.import_edges(files), files)
    got = sorted((r.source, r.target, r.line, r.character) for r in edges.collect())
    assert got == [("src/a.ts", "src/b.tsx", 0, 0), ("src/c.ts", "src/a.ts", 1, 2), ("src/c.ts", "src/a.ts", 3, 17),
                   ("src/test.ts", "src/a.ts", 4, 0), ("src/test.ts", "src/b.tsx", 5, 0), ("src/test.ts", "src/side.css", 3, 30),
                   ("src/test.ts", "src/utils.ts", 0, 0), ("src/test.ts", "src/utils.ts", 3, 10), ("src/test.ts", "types.ts", 1, 0)]


def test_both_sides(make_files):
    files = make_files(SOURCES)
    refs = xref.cross_references(xref.resolve_imports(xref.import_edges(files), files))
    by = {(r.relative_path, r.other, r.line) for r in refs.filter("direction = 'referencedBy'").collect()}
    assert ("src/utils.ts", "src/test.ts", 3) in by and ("src/utils.ts", "src/test.ts", 0) not in by
    assert ("src/a.ts", "src/c.ts", 3) in by and refs.filter("direction = 'references'").count() == 9
    report = {r.report_line for r in xref.reference_report(refs, "comprehensive").collect()}
    assert "  → types.ts (Other) - Line 2\n    Context: import type { Other } from '../types'" in report
    assert any(r.startswith("  ← src/test.ts - Line 4") for r in report)


def test_mutual_imports(make_files):
    files = make_files({"a.ts": "import { b } from './b';", "b.ts": "import { a } from './a';"})
    refs = xref.cross_references(xref.resolve_imports(xref.import_edges(files), files)).collect()
    assert {(r.relative_path, r.direction, r.other) for r in refs} == {
        ("a.ts", "references", "b.ts"), ("b.ts", "references", "a.ts"), ("a.ts", "referencedBy", "b.ts"), ("b.ts", "referencedBy", "a.ts")}


def test_a_target_that_everyone_imports(make_files):
    files = make_files({"hub.ts": "", **{f"d/f{i}.ts": "import '../hub'" for i in range(500)}})
    refs = xref.cross_references(xref.resolve_imports(xref.import_edges(files), files))
    assert refs.filter("relative_path = 'hub.ts' and direction = 'referencedBy'").count() == 500


def test_packages_in_first_seen_order(spark):
    text = "import a from 'z';\nimport b from \"y\"; require('x'); require('z')\nexport { q } from 'w';\nexport x to 'v'"
    row = spark.createDataFrame([(text,)], "c string").select(
        code.package_dependencies(F.col("c")).alias("d"), code.raw_references(F.col("c")).alias("r"),
        code.raw_references(F.col("c"), export_to_only=True).alias("e")).first()
    assert row.d == ["z", "y", "x"]
    assert [(r.file, r.type) for r in row.r] == [("z", "import"), ("y", "import"), ("v", "export"), ("w", "export")]
    assert [r.file for r in row.e] == ["z", "y", "v"]
