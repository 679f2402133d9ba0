"""License scans by MinHash bands over overlapping windows, in native expressions only.

Words are runs of a-z and 0-9 of the lower-cased text; shingles have five words.  For a
template of ``L`` shingles a text is read in windows of ``2 L`` shingles, ``L`` apart, so
that every occurrence lies in one window.  A window that holds 0.75 of a template has a
Jaccard similarity of at least 1/3 with it, and ``bands`` of one MinHash each are as many
as keep the chance of no collision below ``MISS``.  Windows that collide in a band are
verified: the share of the template's shingles that the window holds, exactly.

A band collides only where the window holds the template's own minimum of that band.
Those few shingles are looked up first, so MinHashes are computed for the windows
around them and not for the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

WIDTH, CONTAINED, MISS = 5, 0.75, 1e-4

#: Notices as licences prescribe or as projects commonly write them.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-2", "MIT", "This project is licensed under the MIT License."),
    ("mit-grant", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-header", "LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd-redistribution", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bands_for(similarity: float = CONTAINED / (3 - CONTAINED), miss: float = MISS) -> int:
    """Bands of one MinHash under which a window of this similarity escapes with at most this chance."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def shingles(text: Column, width: int = WIDTH) -> Column:
    """array<bigint>: hash of each run of ``width`` words, in order; empty for fewer words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) >= width, made).otherwise(F.expr("array()").cast("array<bigint>"))

    return F.element_at(F.transform(F.array(hashed), runs), 1)


def _min_hash(values: Column, seed: Column) -> Column:
    return F.array_min(F.transform(values, lambda v: F.xxhash64(v, seed)))


def template_table(spark: SparkSession, templates=TEMPLATES, width: int = WIDTH) -> list[dict]:
    """name, license, its distinct shingles, their number, and the minimum and its shingle for each band.

    A template of fewer than ``width`` words is an error.  One row a template, as many
    as the list has.
    """
    bands = bands_for()
    rows = spark.createDataFrame([*templates], "name string, license string, body string").withColumn("s", F.array_distinct(shingles(F.col("body"), width)))
    by = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.array_min(F.transform(F.col("s"), lambda v: F.struct(F.xxhash64(v, j).alias("low"), v.alias("v")))))
    out = [r.asDict(recursive=True) for r in rows.select("name", "license", "s", by.alias("bands")).collect()]
    for r in out:
        if not r["s"]:
            raise ValueError(f"template {r['name']} has fewer than {width} words")
    return out


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """id, template, license, start, containment: verified windows, the best of each document and template.

    start: the window's first shingle.  Of windows with equal containment the first counts.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    minima = [(b["v"], j, b["low"], t["name"]) for t in table for j, b in enumerate(t["bands"])]
    wanted = F.array(*[F.lit(v) for v in sorted({m[0] for m in minima})])
    base = docs.select(F.col(id_col).alias("id"), shingles(F.col(text_col)).alias("s")).where(F.size(F.array_intersect("s", wanted)) > 0)
    scratch = Scratch(spark, "licenses")
    row = scratch.save(base.withColumn("row", F.monotonically_increasing_id()), "held")
    # templates x bands rows at most, a size that the caller's list proves
    lookup = F.broadcast(spark.createDataFrame(minima, "v long, band int, low long, name string"))
    bodies = F.broadcast(spark.createDataFrame([(t["name"], t["license"], t["s"], len(t["s"])) for t in table], "name string, license string, t array<bigint>, len int"))
    spots = F.filter(F.transform("s", lambda v, i: F.struct(i.alias("p"), v.alias("v"))), lambda x: F.array_contains(wanted, x["v"]))
    hits = row.select("row", F.explode(spots).alias("x")).select("row", F.col("x.p").alias("p"), F.col("x.v").alias("v"))
    near = hits.join(lookup, "v").join(bodies.select("name", "len"), "name")
    starts = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.greatest(F.lit(0), (F.floor(F.col("p") / F.col("len")) - k) * F.col("len")).cast("int")))
    # a window once for each template, with the bands whose minimum it may have
    windows = near.withColumn("start", F.explode(starts)).groupBy("row", "name", "start").agg(F.collect_set(F.struct("band", "low")).alias("bands"))
    checked = windows.join(row, "row").join(bodies, "name").withColumn("w", F.slice("s", F.col("start") + 1, 2 * F.col("len")))
    collides = F.exists("bands", lambda b: _min_hash(F.col("w"), b["band"]) == b["low"])
    share = F.size(F.array_intersect("t", "w")) / F.size("t")
    verified = checked.where(collides).select("id", F.col("name").alias("template"), "license", "start", share.alias("containment")).where(F.col("containment") >= contained)
    best = verified.groupBy("id", "template", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("id", "template", "license", (-F.col("b.s")).cast("int").alias("start"), F.col("b.containment").alias("containment"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """id, licenses, templates (names in order, joined by commas), n_templates, containment (the best) for each row.

    Null and empty texts have none.  Rows with equal ids share what any of them has.
    Empty tables give no rows; other columns are not read.
    """
    found = find_licenses(docs, id_col, text_col, templates)
    each = found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.array_join(F.array_sort(F.collect_set("template")), ",").alias("templates"), F.count("*").alias("n_templates"), F.max("containment").alias("containment"))
    scratch = Scratch(docs.sparkSession, "licensed")
    each = scratch.save(each, "found")
    out = docs.select(F.col(id_col).alias("k")).join(each, F.col("k").eqNullSafe(F.col("id")), "left")
    return out.select(F.col("k").alias(id_col), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("templates", F.lit("")).alias("templates"), F.coalesce("n_templates", F.lit(0)).cast("long").alias("n_templates"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
