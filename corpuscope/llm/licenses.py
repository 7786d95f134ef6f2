"""Scan of texts for license notices.

The words of a text (lower-cased letters and digits) give shingles of five words in a row; a text of fewer
words is one shingle. Templates are sorted into classes by their number of shingles m (a power of two,
rounded up), and for each class the text is cut into overlapping windows of 1.5 m shingles, one every
m / 2, so that every run of m shingles lies whole in some window.

A window retrieves the templates of its class that share a MinHash band with it. A window that contains a
template to ``containment`` (0.8) has a Jaccard similarity of at least 0.8 (m / 2) / (1.5 m + 0.1 m) = 0.25
with it, so with ``bands`` = 64 bands of one row it is missed with a chance below 0.75 ** 64, or one in
ninety million. Retrieved templates are verified exactly: the share of their distinct shingles that the
window has must reach ``containment``. Hashes are the 64 bits of xxhash64.

Only the shingles that some template has are kept, with their places, before windows are made (a broadcast
join of shingle hashes), and a window goes on only with as many of them as the smallest template of its class
needs. This is no approximation. The templates, not the texts, are bounded: they have at most ``MAX_SHINGLES``
shingles, beyond which an error is raised.

Licenses of one family contain each other to ``containment`` (the headers of GPL-2.0 and GPL-3.0 differ in one
word). Every license that is contained gets its row; ``best`` tells those that stand for themselves. Templates of
different licenses that share more than half of the smaller one's shingles are rivals. The templates found in a text
are taken from the most shingles found down (then by containment, then by id), and one is passed over if at least half of
what sets it apart from a rival already taken is missing in its window, or nothing does. A license is best if a template of it is taken.

Defined cases: null, empty or wordless texts match nothing, and such templates are ignored; repeated rows
and null keys give their own result rows; other columns are left out, so no name can clash; of equally good
windows the first is reported; an empty table gives an empty result."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuscope import session

MAX_SHINGLES = 200_000
TEXTS = Path(__file__).parent / "license_texts"  # whole licenses: SPDX identifier, or identifier~variant
SHINGLE = 5

# Customary license notices, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
]


def texts() -> list[tuple[str, str]]:
    """The whole licenses: license, text."""
    return [(path.stem.split("~")[0], path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]


def templates(spark: SparkSession) -> DataFrame:
    """The built-in notices and whole licenses: template_id, license, text."""
    return spark.createDataFrame([(n, *row) for n, row in enumerate([*NOTICES, *texts()])], "template_id int, license string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(parts: Column, size: int = SHINGLE) -> Column:
    """The hash of every run of ``size`` words, by position; of all words if there are fewer."""
    shifted = F.arrays_zip(*[F.slice(parts, n + 1, 2_000_000_000).alias(f"w{n}") for n in range(size)])
    runs = F.slice(F.transform(shifted, lambda w: F.xxhash64(*[w[f"w{n}"] for n in range(size)])), 1, F.greatest(F.size(parts) - (size - 1), F.lit(0)))
    return F.when(F.size(parts) >= size, runs).when(F.size(parts) > 0, F.array(F.xxhash64(F.concat_ws(" ", parts)))).otherwise(
        F.array().cast("array<bigint>"))


def _signature(window: Column, bands: int) -> Column:
    """The band keys of a window or template: band, key."""
    def key(band: Column) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(band, x)))

    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda band: F.struct(band.alias("band"), key(band).alias("band_key")))


def _runs(rows: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """keep, total, at, h: what ``shingles`` makes of the words in ``__parts``, one row each. A projection and a
    generator are compiled, functions over arrays are not."""
    parts, total = F.col("__parts"), F.col("__total")
    rows = rows.withColumn("__total", F.when(F.size(parts) >= size, F.size(parts) - (size - 1)).when(F.size(parts) > 0, 1).otherwise(0))
    each = rows.where(total > 0).select(*keep, "__parts", total, F.explode(F.sequence(F.lit(0), total - 1)).alias("at"))
    run = F.xxhash64(*[F.get(parts, F.col("at") + n) for n in range(size)])
    return each.select(*keep, F.col("__total").alias("total"), "at", F.when(F.size(parts) >= size, run).otherwise(
        F.xxhash64(F.concat_ws(" ", parts))).alias("h"))


def _rivals(known: DataFrame) -> DataFrame:
    """template_id, rival, apart: for templates of different licenses that share most shingles, those that only the first has."""
    other = known.select(F.col("template_id").alias("rival"), F.col("license").alias("rival_license"), F.col("own").alias("rival_own"))
    shared = F.size(F.array_intersect("own", "rival_own"))
    return known.crossJoin(other).where((F.col("license") != F.col("rival_license")) & (2 * shared > F.least(F.size("own"), F.size("rival_own")))).select(
        "template_id", "rival", F.array_except("own", "rival_own").alias("apart"))


def _taken(found: Column) -> Column:
    """Of the templates found in one text, from the most shingles down, those no rival already taken stands for."""
    none = F.filter(found, lambda x: F.lit(False))

    def add(taken: Column, x: Column) -> Column:
        beaten = F.exists(taken, lambda a: F.coalesce(x["evidence"][a["template_id"]] < 0.5, F.lit(False)))
        return F.when(beaten, taken).otherwise(F.concat(taken, F.array(x)))

    return F.aggregate(found, none, add)


def scan(df: DataFrame, notices: DataFrame | None = None, containment: float = 0.8, bands: int = 64,
         text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``df`` and license found in it: key, license, template_id, containment, the words
    [start, end) of the window (in the order of the letters-and-digits words), and whether the license is ``best``."""
    spark = df.sparkSession
    known = (notices if notices is not None else templates(spark)).select(
        "template_id", "license", shingles(words(F.col("text"))).alias("all")).where(F.size("all") > 0)
    known = session.written(known.select("template_id", "license", F.array_distinct("all").alias("own"),
                                         F.pow(F.lit(2), F.ceil(F.log2(F.size("all")))).cast("int").alias("m")), "templates")
    size = known.agg(F.sum(F.size("own")).alias("n")).first()["n"]
    if (size or 0) > MAX_SHINGLES:
        raise ValueError(f"templates of more than {MAX_SHINGLES} shingles")
    # Written, so that sizes are known when joins are planned: bounded templates go to the texts, not the texts to them.
    own = session.written(known.select("m", F.explode("own").alias("h")).groupBy("h").agg(F.collect_set("m").alias("classes")), "shingles")
    hashes = session.written(own.select("h"), "hashes")  # no wider than it must be: all words pass it
    needed = known.groupBy("m").agg(F.min(F.ceil(F.size("own") * containment - 1e-9)).alias("needed"))
    wanted = session.written(known.select("template_id", "m", F.explode(_signature(F.col("own"), bands)).alias("s")).select(
        "template_id", "m", "s.*"), "bands")
    rivals = session.written(_rivals(known), "rivals")
    rows = df.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__row"), words(F.col(text)).alias("__parts"))
    hits = session.written(_runs(rows, ["__key", "__row"]).join(hashes, "h", "left_semi"), "hits")
    # A shingle lies in the windows of its template's class that start at most a window before it.
    m = F.col("m")
    step, length = F.greatest(F.lit(1), F.floor(m / 2).cast("int")), m + F.floor(m / 2).cast("int")
    spots = hits.join(own, "h").select("__row", "total", "at", "h", F.explode("classes").alias("m")).select(
        "__row", "total", "at", "h", "m", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("back")).withColumn(
        "start", ((F.floor(F.col("at") / step) - F.col("back")) * step).cast("int"))
    spots = spots.where((F.col("start") >= 0) & (F.col("at") < F.col("start") + length))
    windows = spots.groupBy("__row", "m", "start").agg(F.collect_set("h").alias("window"), F.first("total").alias("total"))
    windows = windows.join(needed, "m").where(F.size("window") >= F.col("needed"))
    windows = session.written(windows.select("__row", "m", "start", "window", F.least(length, F.col("total") - F.col("start")).alias("n")), "windows")
    banded = windows.select("__row", "m", "start", F.explode(_signature(F.col("window"), bands)).alias("s")).select("__row", "m", "start", "s.*")
    met = banded.join(wanted, ["m", "band", "band_key"]).select("__row", "m", "start", "template_id").distinct()
    both = F.size(F.array_intersect("own", "window"))
    met = met.join(windows, ["__row", "m", "start"]).join(known.drop("m"), "template_id").withColumn("both", both).withColumn(
        "containment", F.col("both") / F.size("own")).where(F.col("containment") >= containment)
    # The best window of each template, and what sets the template apart from its rivals there.
    spot = met.groupBy("__row", "license", "template_id").agg(F.max(F.struct(
        "containment", (-F.col("start")).alias("before"), "n", "both", "window")).alias("b"))
    spot = session.written(spot.select("__row", "license", "template_id", "b.*"), "found")
    apart = F.when(F.size("apart") == 0, 0.0).otherwise(F.size(F.array_intersect("apart", "window")) / F.size("apart"))
    evidence = spot.join(rivals, "template_id").groupBy("__row", "template_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rival", apart))).alias("evidence"))
    ranked = spot.drop("window").join(evidence, ["__row", "template_id"], "left").withColumn(
        "evidence", F.coalesce("evidence", F.create_map().cast("map<int,double>"))).groupBy("__row").agg(F.collect_list(F.struct(
            (-F.col("both")).alias("r1"), (-F.col("containment")).alias("r2"), "template_id", "license", "evidence")).alias("found"))
    order = lambda a, b: F.when(a["r1"] != b["r1"], F.signum(a["r1"] - b["r1"])).when(
        a["r2"] != b["r2"], F.signum(a["r2"] - b["r2"])).otherwise(F.signum(a["template_id"] - b["template_id"])).cast("int")
    standing = ranked.select("__row", F.transform(_taken(F.array_sort("found", order)), lambda x: x["license"]).alias("taken"))
    best = spot.groupBy("__row", "license").agg(F.max(F.struct(
        "containment", "before", (-F.col("template_id")).alias("id"), "n")).alias("b"))
    start = -F.col("b.before")
    keys = hits.select("__row", F.col("__key").alias(key)).distinct()
    return best.join(standing, "__row").join(keys, "__row").select(
        key, "license", (-F.col("b.id")).alias("template_id"), F.col("b.containment").alias("containment"),
        start.alias("start"), (start + F.col("b.n") + (SHINGLE - 1)).alias("end"), F.array_contains("taken", F.col("license")).alias("best"))
