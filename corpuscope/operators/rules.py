"""Ignore rules that are a table: as many as there are, met by key instead of tried one after the other.

A rule is a shell glob (``*`` and ``?`` also match ``/``) and hits a path if it matches the path, or one of its
ancestor directories with or without a trailing slash, as a whole. Each rule has keys out of its literal text:

* ``at``: a rule without wildcards is a path itself; a rule whose literal start holds a ``/`` lies below a directory;
* ``name``: the last name, of a rule that ends in a literal with a ``/`` before it;
* ``ext``: what follows the last dot of the last name, of a rule that ends in a literal with a dot;
* ``word``: every run of letters and digits between others (or the ends), since a path that matches has it as a whole word too.

A path has a key of each kind for itself and each of its ancestors, and its words. A rule can only hit paths that have all
its keys, so it is tried on those that have its rarest one, as counted over the paths: a rule like ``*_4711.md`` is not
tried on every ``.md``. Paths and rules meet by hashes of keys, and the expression of the rule decides about each
pair. What has no whole word and no literal at either end (``*``, ``src*``, ``a?``) can match
anything: such rules, usually a handful, become one expression over the paths.

Only distinct paths move, never contents. A key that very many paths have, such as a common extension, is a
skewed side of the join, which is split at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope import session
from corpuscope.functions import globs, paths
from corpuscope.operators import filters

WILD = r"*?\[\]"


WORD = r"\p{L}\p{N}"
# A class of which every character stands between words: no letter or digit, no range, not negated.
BETWEEN = rf"^\[-?[^{WORD}\[\]!^-]+-?\]$"


def _key(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def _words(text: Column, edge: str = "") -> Column:
    """The runs of letters and digits that are not beside a character of ``edge``."""
    beside = WORD + edge
    return F.regexp_extract_all(text, F.lit(rf"(?<![{beside}])[{WORD}]+(?![{beside}])"), F.lit(0))


def _whole_words(rule: Column) -> Column:
    """The words of a rule that a path has to have as whole words: what can match anything is put as ``*`` first."""
    tokens = F.regexp_extract_all(rule, F.lit(globs.TOKEN), F.lit(0))
    spelled = F.array_join(F.transform(tokens, lambda token: (
        F.when(token.rlike(r"^[*?]"), "*").when(token.rlike(BETWEEN), "/").when(token.startswith("[") & (F.length(token) > 1), "*")
        .otherwise(token))), "")
    return _words(spelled, "*")


def indexed(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, keys, regex) of distinct rules; a rule that no key stands for has none."""
    rule = F.col("pattern")
    plain = F.rtrim(rule, F.lit("/"))
    start = F.regexp_extract(rule, rf"(?s)^([^{WILD}]*)/", 1)  # the directory that the literal start names
    end = F.regexp_extract(plain, rf"(?s)([^{WILD}]*)\z", 1)
    name = paths.file_name(end)
    ends = (
        F.when(rule.rlike(rf"(?s)^[^{WILD}]*/"), _key("at", F.rtrim(start, F.lit("/"))))
        .when(F.contains(end, F.lit("/")), _key("name", name))
        .when(F.contains(end, F.lit(".")), _key("ext", paths.last_piece(end))))
    words = F.transform(_whole_words(rule), lambda word: _key("word", word))
    keys = F.when(~rule.rlike(rf"[{WILD}]"), F.array(_key("at", plain))).otherwise(F.array_compact(F.concat(F.array(ends), words)))
    return (
        rules.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL AND pattern <> ''").distinct()
        .select("pattern", F.array_distinct(keys).alias("keys"), filters.rule_regex(globs.shell_regex_column(rule)).alias("regex")))


def path_keys(path: Column) -> Column:
    """The distinct keys of a path and its ancestors."""
    itself = F.concat(F.array(path), paths.ancestors(path))

    def of(part: Column) -> Column:
        name = paths.file_name(part)
        return F.array(_key("at", part), _key("name", name), _key("ext", paths.last_piece(name)))

    words = F.transform(_words(path), lambda word: _key("word", word))
    return F.array_distinct(F.concat(F.flatten(F.transform(itself, of)), words))


def rarest(keyed: DataFrame, met: DataFrame) -> DataFrame:
    """key, regex: each rule by that of its keys which the fewest paths have; none if no path has one of them."""
    counts = met.groupBy("key").agg(F.count("*").alias("n"))
    each = keyed.select("pattern", "regex", F.explode("keys").alias("key")).join(counts, "key", "left")
    fewest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("at")
    return each.groupBy("pattern", "regex").agg(fewest).where("at.n > 0").select("at.key", "regex")


def hit_paths(files: DataFrame, rules: DataFrame, path: str = "relative_path", pattern: str = "pattern") -> DataFrame:
    """The distinct paths that some rule hits."""
    known = session.written(indexed(rules, pattern), "rules")
    every = session.written(files.select(F.col(path).alias("path")).distinct(), "paths")
    keys = every.select("path", F.explode(path_keys(F.col("path"))).alias("key"))
    keyed = session.written(rarest(known.where("size(keys) > 0"), keys), "keyed")
    found = keys.join(keyed, "key").where(F.expr("path RLIKE regex")).select("path")
    # Patterns that can match anything are needed whole, as they become an expression.
    loose = known.where("size(keys) = 0").agg(F.array_sort(F.collect_list("regex")).alias("all")).first()["all"]
    for at in range(0, len(loose), filters.RULES_PER_EXPRESSION):
        either = "|".join(f"(?:{regex})" for regex in loose[at: at + filters.RULES_PER_EXPRESSION])
        found = found.unionByName(every.where(F.col("path").rlike(either)))
    return found.distinct().withColumnRenamed("path", path)


def outside_rule_table(files: DataFrame, rules: DataFrame, path: str = "relative_path", pattern: str = "pattern") -> DataFrame:
    """Drop files that a rule of the table hits."""
    hits = session.written(hit_paths(files, rules, path, pattern), "hits")
    return files.join(hits, path, "left_anti")
