import re

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import matches, sensitive
from corpuscope.operators import filters, rollup

TEXT = ("é start\nAPI_KEY = \"k-1\"; 'auth-token': 'tok'\npwd=\"p\" password = \"password\"\n"
        "email: 'a.b@c.org' e-mail='bad'\n-----BEGIN RSA PRIVATE KEY-----\nAB+/=\n-----END RSA PRIVATE KEY-----\nend")


def test_builtin_patterns_against_python(make_files):
    rows = rollup.sensitive_matches(make_files({"a": TEXT, "b": "clean"})).collect()
    wanted = set()
    for p in sensitive.BUILT_IN_PATTERNS:
        for m in re.finditer(f"(?:{p.before})({p.value})(?:{p.after})", TEXT, re.I):
            wanted.add(("a", p.name, m[0], m[1], m.start(), m.end(), m.start(1)))
    assert {tuple(r) for r in rows} == wanted and len(wanted) == 6


def test_redaction_masks_only_values(spark):
    rows = spark.createDataFrame([(TEXT,), ("clean",)], "c string")
    masked, clean = [r[0] for r in rows.select(sensitive.redacted(F.col("c"))).collect()]
    assert clean == "clean" and len(masked) == len(TEXT)
    assert 'API_KEY = "***"; \'auth-token\': \'***\'' in masked and 'pwd="*" password = "********"' in masked
    assert "email: '*********' e-mail='bad'" in masked and "RSA" not in masked


def test_overlapping_hits_mask_their_union(spark):
    patterns = sensitive.custom_patterns(["abcd", "cdef", "x+"])
    rows = spark.createDataFrame([("--abcdef--xx-abcd",)], "c string")
    assert rows.select(sensitive.redacted(F.col("c"), patterns)).first()[0] == "--******--**-****"


def test_invalid_custom_patterns_are_reported(spark):
    with pytest.warns(UserWarning) as seen:
        kept = sensitive.custom_patterns(["ok(a|b)", "(", "x*", "(?P<k>tok)en", r"\b"])
    assert [p.name for p in kept] == ["ok(a|b)"] and len(seen) == 4


def test_custom_patterns_may_look_around_and_refer_back(spark):
    patterns = sensitive.custom_patterns(["(?<=X)b", r"(\w)\1-", "école"])
    rows = spark.createDataFrame([("Xb Xb",), ("Xb Xb\x01\x02",), ("aa-ab-ÉCOLE",)], "c string")
    assert [r[0] for r in rows.select(sensitive.redacted(F.col("c"), patterns)).collect()] == ["X* X*", "X* X*\x01\x02", "***ab-*****"]


def test_custom_pattern_value_is_the_whole_match(make_files):
    rows = rollup.sensitive_matches(make_files({"a": "zz TOKEN=(1) token=(2)"}), sensitive.custom_patterns([r"token=(\(\d\))"]))
    assert [(r.matched, r.value, r.start, r.value_start) for r in rows.orderBy("start").collect()] == [
        ("TOKEN=(1)", "TOKEN=(1)", 3, 3), ("token=(2)", "token=(2)", 13, 13)]


def test_many_matches(spark):
    text = "".join(f"pwd='{'s' * (i % 7 + 1)}' text {i}\n" for i in range(3000))
    row = spark.createDataFrame([(text,)], "c string").select(
        F.size(sensitive.found(F.col("c"))).alias("n"), sensitive.redacted(F.col("c")).alias("m")).first()
    assert row.n == 3000 and row.m == re.sub(r"'(s+)'", lambda m: "'" + "*" * len(m[1]) + "'", text)


def test_time_grows_with_the_matches(spark):
    """64,000 matches in one text."""
    import time

    text = "é pwd='x' " * 64_000
    df = spark.createDataFrame([(text,)], "c string")
    start = time.time()
    row = df.select(F.size(sensitive.found(F.col("c"))).alias("n"), sensitive.redacted(F.col("c")).alias("m")).first()
    assert row.n == 64_000 and row.m == text.replace("'x'", "'*'")
    assert time.time() - start < 60


@pytest.mark.parametrize("policy,kept,flagged", [("warn", 2, 1), ("redact", 2, 0), ("skip", 1, 0), ("ignore", 2, 0)])
def test_policies(make_files, policy, kept, flagged):
    out = filters.apply_sensitive_policy(make_files({"a": "pwd='x'", "b": "y"}), policy).collect()
    assert len(out) == kept and sum(r.is_flagged for r in out) == flagged
    if policy == "redact":
        assert {r.content for r in out} == {"pwd='*'", "y"}


def test_unknown_policy(make_files):
    with pytest.raises(ValueError):
        filters.apply_sensitive_policy(make_files({"a": "b"}), "drop")


def test_texts_with_the_internal_marks(make_files):
    text = "a\x01b pwd='x\x02y' \x01\x02 pwd='z'\n pwd=\"\x01\""
    rows = rollup.sensitive_matches(make_files({"a": text, "b": text.replace("\x01", "#").replace("\x02", "#")})).collect()
    wanted = [(m[1], m.start(), m.end(), m.start(1)) for m in re.finditer(r"""pwd=['"]([^'"]+)['"]""", text)]
    assert len(wanted) == 3
    for path in "ab":
        got = sorted((r.value, r.start, r.end, r.value_start) for r in rows if r.relative_path == path)
        assert [g[1:] for g in sorted(got, key=lambda g: g[1])] == [w[1:] for w in wanted]
    assert sorted(r.value for r in rows if r.relative_path == "a") == sorted(w[0] for w in wanted)


EMPTY_ALTERNATIVES = ["(?=q)|tok", "tok|(?=q)|$", "(?<=x)|q ", "(?:t|q)(?=o)|(?! )", "o?"]


@pytest.mark.parametrize("mark", ["", matches.OPEN, matches.CLOSE + "z" + matches.NEXT])
@pytest.mark.parametrize("expression", EMPTY_ALTERNATIVES)
def test_empty_matches_are_no_hits_and_move_nothing(spark, expression, mark):
    """Against the engine's own matcher."""
    texts = [mark + x for x in ("q tok x tok y", "tok", "q", "", "xq qtok\n q  tokq", "é q tok", "ooo")]
    pattern = sensitive.SensitivePattern(expression, "", expression, "", "(?iu)", may_be_empty=True)
    compiled = spark._jvm.java.util.regex.Pattern.compile(f"(?iu){expression}")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select(
        "i", sensitive.found(F.col("c"), [pattern]).alias("f"), sensitive.redacted(F.col("c"), [pattern]).alias("r"),
        sensitive.is_sensitive(F.col("c"), [pattern]).alias("s")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        matcher, wanted, masked = compiled.matcher(text), [], list(text)
        while matcher.find():
            if matcher.end() > matcher.start():
                wanted.append((matcher.group(), matcher.start(), matcher.end()))
                masked[matcher.start():matcher.end()] = "*" * (matcher.end() - matcher.start())
        assert [(h.matched, h.start, h.end) for h in row.f] == wanted
        assert row.r == "".join(masked) and row.s == bool(wanted)


def test_an_accepted_pattern_with_an_empty_alternative_leaks_nothing(make_files):
    patterns = sensitive.custom_patterns(["(?=q)|tok"])
    out = filters.apply_sensitive_policy(make_files({"a": "q tok x tok y", "b": "q only"}), "redact", patterns).collect()
    assert {r.content for r in out} == {"q *** x *** y", "q only"}
    kept = filters.apply_sensitive_policy(make_files({"a": "q tok", "b": "q only"}), "skip", patterns).collect()
    assert [r.relative_path for r in kept] == ["b"]
