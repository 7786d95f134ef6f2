import fnmatch
import itertools
import posixpath
import re

from pyspark.sql import functions as F

from corpuscope.functions import globs, paths
from corpuscope.operators import filters
from corpuscope.sources import ignore

PATHS = ["a.py", "a/b.py", "a/b/c.tmp", ".env", "x.env", "a/.env", "a/x.lock", "node_modules/p/i.js",
         "s/node_modules/i.js", "out/a", "a/out/b/c.ts", ".git/index", "a/.vscode/x", "docs/é.md", "a b/c-d.txt",
         "test/[x].py", "dist", "a/dist.js", "ab", "abc/d"]


def test_shell_globs_mean_what_fnmatch_means():
    patterns = ["*.py", "a/*", "?", "a?", "*", "[ab]*", "[!a]*", "**/b.py", "a/**", "*.t?p", "docs/*.md", "a b/*-*",
                "[x", "test/[[]x].py", "*[.]env", "a**c", "", "[a-c]b*"]
    for pattern, path in itertools.product(patterns, PATHS):
        mine = re.fullmatch(globs.shell_regex(pattern), path) is not None
        assert mine == fnmatch.fnmatchcase(path, pattern), (pattern, path)


def test_path_globs_stay_in_segments_and_skip_dot_names():
    wanted = {
        "**/*.env": {"x.env"}, "**/*.lock": {"a/x.lock"},
        "**/node_modules/**": {"node_modules/p/i.js", "s/node_modules/i.js"},
        "**/out/**": {"out/a", "a/out/b/c.ts"}, "**/.git/**": {".git/index"}, "**/.vscode/**": {"a/.vscode/x"},
        "*.py": {"a.py"}, "a/*.py": {"a/b.py"}, "a/**": {"a/b.py", "a/b/c.tmp", "a/x.lock", "a/out/b/c.ts", "a/dist.js"},
        "**/*.{tmp,md}": {"a/b/c.tmp", "docs/é.md"}, "?b": {"ab"}, "*": {"a.py", "x.env", "dist", "ab"},
    }
    for pattern, hits in wanted.items():
        assert {p for p in PATHS if re.search(globs.path_regex(pattern), p)} == hits, pattern


def test_ignore_lines():
    lines = ["# no", "", " *.tmp ", "/ignore_dir/", "ignored_file.txt", "a/b", "!keep"]
    assert globs.ignore_patterns(lines) == [
        "*.tmp", "ignore_dir/**", "ignore_dir", "ignored_file.txt/**", "ignored_file.txt", "**/a/b", "!keep/**", "!keep"]


def _ignored(path, patterns):
    ancestors, parent = [path], posixpath.dirname(path)
    while parent:
        ancestors += [parent, parent + "/"]
        parent = posixpath.dirname(parent)
    return any(fnmatch.fnmatchcase(a, p) for a in ancestors for p in patterns)


def test_rules_against_brute_force(spark):
    patterns = globs.ignore_patterns(["*.tmp", "/ignore_dir/", "ignored_file.txt", "a/*", "docs/", "*/out/", "nod?_modules"])
    given = PATHS + ["file.tmp", "ignore_dir/file.txt", "ignored_file.txt", "file.txt", "x/ignored_file.txt"]
    rows = spark.createDataFrame([(p,) for p in given], "relative_path string")
    kept = {r[0] for r in filters.outside_rules(rows, patterns).collect()}
    assert kept == {p for p in given if not _ignored(p, patterns)}
    assert "file.txt" in kept and not kept & {"file.tmp", "ignore_dir/file.txt", "ignored_file.txt"}


def test_many_rules_become_several_expressions(spark):
    patterns = [f"name{i}" for i in range(1200)]
    rows = spark.createDataFrame([("name3/x",), ("name1199",), ("other",)], "relative_path string")
    assert [r[0] for r in filters.outside_rules(rows, patterns).collect()] == ["other"]


def test_rules_as_table_agree_with_rules_as_list(spark):
    lines = ["*.tmp", "/ignore_dir/", "ignored_file.txt", "a/b", "# c", "docs/?x[!a].md"]
    table = ignore.rules_from_lines(spark.createDataFrame([(x,) for x in lines], "text string")).collect()
    assert sorted(r["pattern"] for r in table) == sorted(globs.ignore_patterns(lines))
    for row in table:
        for path in [*PATHS, "file.tmp", "ignore_dir/x", "x/a/b", "q/docs/1xb.md"]:
            assert (re.search(row["regex"], path) is not None) == fnmatch.fnmatchcase(path, row["pattern"])


def test_builtin_ignore_and_text(make_files):
    files = make_files({p: "x" for p in ["node_modules/test.js", ".git/index", "main.py", "image.png", "test.py"]})
    kept = filters.text_only(filters.not_ignored(files))
    assert sorted(r.relative_path for r in kept.collect()) == ["main.py", "test.py"]


def test_bare_name_is_its_own_extension_in_the_document_dialect(make_files):
    files = make_files({"png": "x", "a.PNG": "x", "b.ppt": "x", "c.ts": "x"})
    assert sorted(r.relative_path for r in filters.text_only(files, "document").collect()) == ["c.ts"]
    assert sorted(r.relative_path for r in filters.text_only(files).collect()) == ["b.ppt", "c.ts", "png"]


def test_directory_prefix_and_types(make_files):
    files = make_files({p: "x" for p in ["src/a.py", "a/srcs/b.ts", "lib/c.py", "lib/src.md", "x.py"]})
    kept = filters.outside_directories(files, ["src"])
    assert sorted(r.relative_path for r in kept.collect()) == ["lib/c.py", "x.py"]
    assert filters.of_types(files, ["*"], ["py"]).count() == 2
    assert filters.of_types(files, ["ts", "md"]).count() == 2


def test_normalize_and_parts(spark):
    rows = spark.createDataFrame(
        [("a/b/../../x/./y",), ("../../x",), ("./a",), ("a/../..",), ("x",)], "p string")
    got = [r[0] for r in rows.select(paths.normalize(F.col("p"))).collect()]
    assert got == ["x/y", "../../x", "a", "..", "x"]
    rows = spark.createDataFrame([("a/b/c.Tar.GZ",), ("x.py",), ("d/.env",), ("LICENSE",)], "p string")
    got = [tuple(r[0]) for r in rows.select(paths.parts(F.col("p"))).collect()]
    assert got == [("c.Tar.GZ", "a/b", "b", ".gz"), ("x.py", ".", ".", ".py"), (".env", "d", "d", ""), ("LICENSE", ".", ".", "")]


def test_languages(spark):
    rows = spark.createDataFrame([("test.py",), ("test.js",), ("test.txt",), ("a.h",), ("b.sh",)], "p string")
    tree, document = zip(*[tuple(r) for r in rows.select(
        paths.language(F.col("p")), paths.language(F.col("p"), "document")).collect()])
    assert tree == ("python", "javascript", "plaintext", "c", "shell")
    assert document == ("python", "javascript", "plaintext", "objective-c", "shellscript")
