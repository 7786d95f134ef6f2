import fnmatch
import itertools
import random

from pyspark.sql import functions as F

from corpuscope.operators import filters, rules


def hit(path, patterns):
    parts = path.split("/")
    above = ["/".join(parts[:i]) for i in range(1, len(parts))]
    return any(fnmatch.fnmatchcase(x, p) for x in [path, *above, *(a + "/" for a in above)] for p in patterns)


def kept(spark, given, patterns):
    files = spark.createDataFrame([(p, "x", 1) for p in given], "relative_path string, kind string, key int")
    table = spark.createDataFrame([(p, "note") for p in patterns], "pattern string, regex string")
    out = rules.outside_rule_table(files, table)
    assert out.columns == files.columns
    return sorted(r.relative_path for r in out.collect())


def test_every_shape_against_brute_force(spark):
    names = ["a", "b.md", "b.tar.gz", ".env", "x[1].c", "a.b", "md"]
    given = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(names, repeat=n)] + ["a b/ü.md", "deep/er/and/deeper/b.md"]
    patterns = ["a/b.md", "a", ".env/", "a/*", "a/b*/md", "*.md", "*.tar.gz", "*/md", "**/.env", "b.*/a", "?", "[ab]", "a/[!a]", "x[[]1].c", "*/b.md/",
                "a.b/**", "*", "zzz", "", "a//", "*er/b.md", "deep/er/*/b.md", "* *", "[!.]*gz", "*.", "./a", "a/b.md/a*",
                "[z-a]", "[!z-a]", "[]a]", "[a-", "a[", "[!]a]*", "[a-c&&a].md", "[\\^a]", "x[[]1]*", "[.-b]*"]
    for pattern in patterns:
        assert kept(spark, given, [pattern]) == sorted(p for p in given if not hit(p, [pattern])), pattern


def test_random_tables(spark):
    draw = random.Random(6)
    piece = lambda: draw.choice(["a", "b", "ab", "a.c", "b.c", "c"])
    given = ["/".join(piece() for _ in range(draw.randrange(1, 5))) for _ in range(150)]
    for _ in range(4):
        patterns = ["".join(draw.choice(["a", "b", "c", ".", "/", "*", "?", "[ab]"]) for _ in range(draw.randrange(1, 7))) for _ in range(6)] + [None]
        assert kept(spark, given, patterns) == sorted(p for p in given if not hit(p, [x for x in patterns if x]))


def test_no_nested_loop_over_paths(spark):
    files = spark.range(50).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id", F.lit(".md")).alias("relative_path"))
    table = spark.range(2000).select(F.concat(F.lit("d"), F.col("id"), F.lit("/f*"), "id", F.lit("?md")).alias("pattern"))
    plan = rules.hit_paths(files, table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rules.hit_paths(files, table.limit(0)).count() == 0 and rules.hit_paths(files.limit(0), table).count() == 0


def test_table_equals_list(spark):
    patterns = ["d1/*", "*3.md", "**/f5.md", "d2", "f*"]
    files = spark.range(60).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id", F.lit(".md")).alias("relative_path"))
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    want = sorted(r[0] for r in filters.outside_rules(files, patterns).collect())
    assert sorted(r[0] for r in rules.outside_rule_table(files, table).collect()) == want


def test_words_and_classes_against_brute_force(spark):
    draw = random.Random(9)
    pick = lambda xs: draw.choice(xs)
    word = lambda: pick(["a", "b", "1", "12", "ab", "ü", "a1"])
    given = sorted({pick(["/", "-", ".", "_", "^"]).join(word() for _ in range(draw.randrange(1, 5))).strip("/") for _ in range(250)})
    pieces = ["*", "?", "[.-]", "[-._]", "[!a]", "[+-~]", "[/^]", "[^.]", "[_a]", "[a[.]", "[", ".", "/", "-", "_"]
    for _ in range(5):
        patterns = ["".join(pick([word(), word(), pick(pieces)]) for _ in range(draw.randrange(1, 6))) for _ in range(8)]
        patterns = [p for p in patterns if "[^" not in p]  # fnmatch escapes a leading ^, which stands for itself in both
        patterns += [f"{word()}[/^]{word()}*", f"*[.-]{word()}[_.]?", f"*{word()}[+-~]{word()}"]
        assert kept(spark, given, patterns) == sorted(p for p in given if not hit(p, patterns)), patterns


def test_each_rule_is_tried_on_few_paths(spark):
    """Rules that share an extension, a directory, or have no literal end are told apart by their other words."""
    n = 200
    files = spark.range(n).select(F.concat(F.lit("src/en/doc_"), "id", F.lit(".md")).alias("path"))
    shapes = ["concat('*_', id, '.md')", "concat('src/en/*_', id, '[.-]*')", "concat('sr?/*_', id, '.*')", "concat('*/doc_', id, '.md')"]
    table = rules.indexed(spark.range(n + 50).selectExpr(f"inline(transform(array({', '.join(shapes)}), x -> struct(x AS pattern)))"))
    assert table.where("size(keys) = 0").count() == 0
    keys = files.select("path", F.explode(rules.path_keys(F.col("path"))).alias("key"))
    assert keys.join(rules.rarest(table, keys), "key").count() == n * len(shapes)
