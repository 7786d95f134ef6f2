import re

import pytest

from corpuscope.llm import licenses
from corpuscope.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def brute(rows, notices):
    out = set()
    for key, text in rows:
        own, best = shingles(text), {}
        for number, name, notice in notices:
            wanted = set(shingles(notice))
            if not wanted or not own:
                continue
            m = 1 << (len(shingles(notice)) - 1).bit_length()
            for start in range(0, len(own), max(1, m // 2)):
                window = own[start:start + m + m // 2]
                share = len(wanted & set(window)) / len(wanted)
                if share >= 0.8:
                    best[name] = max(best.get(name, (0,)), (share, -start, -number, len(window)))
        out |= {(str(key), name, -b[2], round(b[0], 9), -b[1], -b[1] + b[3] + 4) for name, b in best.items()}
    return sorted(out)


def found(df, notices=None):
    return sorted((str(r[0]), r.license, r.template_id, round(r.containment, 9), r.start, r.end) for r in licenses.scan(df, notices).collect())


NOTICES = [(n, *x) for n, x in enumerate(licenses.NOTICES)]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op9_license_scan"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.license, r.template_id, round(r.containment, 9), r.start, r.end) for r in rows) == brute(docs, NOTICES)
    said = {k for k, t in docs if re.search("licensed under|MIT License", t, re.I)}
    assert {r.doc_id for r in rows} == said


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    long = "word " * 20_000 + mit + " tail" * 20_000
    program = licenses.NOTICES[7][1]
    rows = [(1, None), (2, ""), (3, "..."), (4, mit), (4, mit), (None, "x " + mit.upper()), (5, long), (6, "released under the"),
            (7, program.replace("at your option", "if you wish")), (8, program[:100]), (9, "Licensed under  cc-by-nc\n4.0! " + mit)]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, license string, start int")
    wanted = sorted([*brute(rows, NOTICES), *brute([(4, mit)], NOTICES)])
    assert found(df) == wanted and ("4", "MIT", 8, 1.0, 0, 5) in wanted
    assert found(df.limit(0)) == []


def test_other_templates(spark):
    notices = spark.createDataFrame([(1, "A", "one two"), (2, "B", None), (3, "C", "a b c d e f g h i j k"), (4, "D", "")],
                                    "template_id int, license string, text string")
    df = spark.createDataFrame([(1, "one two"), (2, "z a b c d e f g h i j q"), (3, "one two three")], "doc_id long, text string")
    assert found(df, notices) == brute([tuple(r) for r in df.collect()], [tuple(r) for r in notices.collect()])
    assert found(df, notices.where("template_id in (2, 4)")) == []


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op9_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_too_many_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MAX_SHINGLES", 3)
    with pytest.raises(ValueError, match="shingles"):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


def test_whole_licenses_and_families(spark):
    """Whole texts and headers are found, and of a family only the license that is there is best."""
    whole = dict(licenses.texts())
    header = {n: t for n, t in licenses.NOTICES if "redistribute it and/or modify" in t and "any later" in t}
    rows = [(f"{name} text", name, text) for name, text in licenses.texts()]
    rows += [(f"{name} header", name, f"word {text} tail") for name, text in header.items()]
    rows += [("edited", "ISC", "Copyright Somebody " + whole["ISC"].replace("THE AUTHOR", "SOMEBODY")),
             ("share", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
             ("gpl", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
             ("two", "GPL-2.0,LGPL-2.1", header["GPL-2.0"] + " " + header["LGPL-2.1"])]
    got = {}
    for r in licenses.scan(spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id string, text string")).collect():
        if r.best:
            got.setdefault(r.doc_id, set()).add(r.license)
    for name, wanted, _ in rows:
        assert set(wanted.split(",")) <= got[name], name
        if not name.endswith("text"):
            assert got[name] == set(wanted.split(",")), name
    assert got["BSD-2-Clause text"] == {"BSD-2-Clause"} and got["BSD-3-Clause text"] == {"BSD-3-Clause"}
