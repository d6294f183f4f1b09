"""License scans with DataFrame functions only.

Templates of license texts and notices are cut into word shingles. Texts are read as words; their
shingles are looked up in the templates' vocabulary (a broadcast of the templates, which are a
bounded parameter), and only shingles that some template holds go on: nothing else can count
towards a containment. They fall into overlapping windows, by size class: in class c, windows of
2c words begin every c words, so that a template of at most c words lies wholly in one of them.
Every window has min-hashes of its class's shingles; bands of them are joined to the templates'
bands and retrieve candidate templates. The exact containment decides: a shingle at word p of the
text that stands at word j of the template has offset p - j; among the window's matched shingles
those count whose offsets lie within ``slack`` of one another, so that they stand in the template's
order and as close together, with at most so many words put in or left out. Containment is the
largest share of the template's distinct shingles that one such range of offsets holds.

Bands: classes are powers of two, so a template of class c has more than c / 2 words, and windows
see texts through the vocabulary of their class. A window that holds ``containment`` = 0.8 of a
template of n shingles holds at most 2c - 2 shingles in all, so their similarity is at least
0.8 n / (0.2 n + 2c - 2), which is never below 0.15 (``least_similarity``), however many other
templates stand beside it. ``bands_for`` gives the number of one-row bands that miss a pair of that
similarity with a chance of at most ``miss``.

Defined results: words are runs of ASCII letters and digits, case ignored; null and empty texts
hold no license; templates may have any length; one row per document row's id, text and template,
its best window and range (largest containment, then the first); rows that repeat in id and text
count once; a null doc_id stays null.
"""

from __future__ import annotations

import re
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmix.llm.common import table, values_sql

SHINGLE = 3
CONTAINMENT = 0.8
#: Share of a template's words that may be put in or left out between matched shingles, and at least so many words.
SLACK, LEAST_SLACK = 0.125, 2

#: (license id, text). Notices and opening grants that identify public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT-notice", "Released under the MIT License"),
    ("MIT-notice-alt", "Licensed under the MIT License"),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions",
    ),
    (
        "ISC-grant",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary-notice", "All rights reserved"),
)


def template_shingles(templates=TEMPLATES, shingle: int = SHINGLE) -> list[tuple[int, int, int, int, str]]:
    """(template index, class, slack, place, shingle) of all shingles."""
    out = []
    for i, (_, text) in enumerate(templates):
        words = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]
        if len(words) < shingle:
            raise ValueError(f"template {i} has fewer than {shingle} words")
        size = 1 << (len(words) - 1).bit_length()
        slack = max(LEAST_SLACK, ceil(SLACK * len(words)))
        out += [(i, size, slack, j, " ".join(words[j : j + shingle])) for j in range(len(words) - shingle + 1)]
    return out


def least_similarity(known: list[tuple[int, int, int, int, str]], containment: float, shingle: int = SHINGLE) -> float:
    """Smallest similarity that a template and a window that holds it can have, whatever else the window holds."""
    distinct: dict[tuple[int, int], set] = {}
    for i, size, _, _, s in known:
        distinct.setdefault((i, size), set()).add(s)
    vocabulary = {size: {s for _, c, _, _, s in known if c == size} for _, size in distinct}
    least = 1.0
    for (_, size), own in distinct.items():
        held = ceil(containment * len(own))
        beside = min(2 * size - shingle + 1 - held, len(vocabulary[size] - own))
        least = min(least, held / (len(own) + max(beside, 0)))
    return least


def bands_for(similarity: float, rows: int = 1, miss: float = 1e-6) -> int:
    return ceil(log(miss) / log(1 - similarity**rows))


def _minhash(band: int) -> Column:
    return F.xxhash64("shingle", F.lit(band))


def license_scan(
    docs: DataFrame,
    templates=TEMPLATES,
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    miss: float = 1e-6,
) -> DataFrame:
    """docs(doc_id, text, ..) -> (doc_id, license_id, matched, template_shingles, containment, word_begin, word_end).

    word_begin and word_end bound the words of the matched shingles of the best range.
    """
    spark = docs.sparkSession
    known = template_shingles(templates, shingle)
    bands = bands_for(least_similarity(known, containment, shingle), miss=miss)
    t = spark.sql(f"SELECT * FROM {values_sql(known, ['template', 'class', 'slack', 'place', 'shingle'])}").withColumn("hash", F.xxhash64("shingle"))
    vocabulary = t.groupBy("hash", "shingle").agg(F.collect_set("class").alias("in_classes"))
    places_of = t.groupBy("template", "class", "slack", "shingle").agg(F.collect_list("place").alias("at"))
    sizes = places_of.groupBy("template", "class", "slack").agg(F.count("*").alias("size"), F.map_from_entries(F.collect_list(F.struct("shingle", "at"))).alias("all"))
    sketch = t.groupBy("template", "class").agg(*[F.min(_minhash(b)).alias(f"m{b}") for b in range(bands)])
    buckets = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("value")) for b in range(bands)])
    template_bands = sketch.select("template", "class", F.explode(buckets).alias("bucket"))

    words = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+"), F.lit(0)).alias("words")
    )
    places = words.select("doc_id", "text_key", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - shingle)
    parts = F.concat_ws(" ", *[F.get("words", F.col("pos") + i) for i in range(shingle)])
    spelt = places.select("doc_id", "text_key", F.col("pos"), F.lower(parts).alias("shingle")).withColumn("hash", F.xxhash64("shingle"))
    hits = spelt.join(F.broadcast(vocabulary), ["hash", "shingle"]).select(
        "doc_id", "text_key", "pos", "shingle", F.explode("in_classes").alias("class")
    )
    window = F.floor(F.col("pos") / F.col("class"))
    windowed = hits.select("*", F.explode(F.array(window, window - 1)).alias("window")).where(
        # the last shingle of a window ends inside it
        F.col("pos") + shingle <= (F.col("window") + 2) * F.col("class")
    )
    found = windowed.groupBy("doc_id", "text_key", "class", "window").agg(
        F.collect_set(F.struct("shingle", "pos")).alias("held"), *[F.min(_minhash(b)).alias(f"m{b}") for b in range(bands)]
    )
    candidates = (
        found.select("doc_id", "text_key", "class", "window", "held", F.explode(buckets).alias("bucket"))
        .join(F.broadcast(template_bands), ["class", "bucket"])
        .groupBy("doc_id", "text_key", "class", "window", "template")
        .agg(F.first("held").alias("held"))
    )
    offsets = F.flatten(
        F.transform(
            F.filter("held", lambda x: F.map_contains_key("all", x["shingle"])),
            lambda x: F.transform(F.element_at("all", x["shingle"]), lambda j: F.struct((x["pos"] - j).alias("offset"), x["pos"].alias("pos"), x["shingle"].alias("shingle"))),
        )
    )
    near = lambda o: F.filter("mine", lambda m: (m["offset"] >= o) & (m["offset"] <= o + F.col("slack")))
    ranges = F.transform(
        F.array_distinct(F.transform("mine", lambda m: m["offset"])),
        lambda o: F.struct(
            F.size(F.array_distinct(F.transform(near(o), lambda m: m["shingle"]))).cast("long").alias("matched"), (-o).cast("long").alias("before"),
        ),
    )
    verified = (
        candidates.join(F.broadcast(sizes), ["template", "class"])
        .withColumn("mine", offsets)
        .where(F.size("mine") > 0)
        .withColumn("range", F.array_max(ranges))
        .where(F.col("range.matched") >= F.ceil(F.col("size") * F.lit(containment)))
        .withColumn("mine", near(-F.col("range.before")))
        .select(
            "doc_id", "text_key", "template", "window", "size", "range",
            F.array_min(F.transform("mine", lambda m: m["pos"])).cast("long").alias("word_begin"),
            (F.array_max(F.transform("mine", lambda m: m["pos"])) + shingle).cast("long").alias("word_end"),
        )
    )
    best = verified.groupBy("doc_id", "text_key", "template").agg(
        F.max_by(F.struct(F.col("range.matched").alias("matched"), "size", "word_begin", "word_end"), F.struct("range.matched", -F.col("window"), "range.before")).alias("b")
    )
    names = F.element_at(F.array(*[F.lit(n) for n, _ in templates]), F.col("template") + 1)
    return best.select(
        "doc_id", names.alias("license_id"), "b.matched", F.col("b.size").alias("template_shingles"),
        F.round(F.col("b.matched") / F.col("b.size"), 6).alias("containment"), "b.word_begin", "b.word_end",
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def oracle(shingle: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """Containment of every template in every window, without min-hashes."""
    names = values_sql([(i, n) for i, (n, _) in enumerate(TEMPLATES)], ["template", "license_id"])
    known = values_sql(template_shingles(), ["template", "class", "slack", "place", "shingle"])
    spelt = " || ' ' || ".join(f"lower(words[pos + {i}])" for i in range(1, shingle + 1))
    return f"""
WITH known AS (SELECT * FROM {known}),
sizes AS (SELECT template, count(DISTINCT shingle) AS size FROM known GROUP BY template),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, words, unnest(range(0, len(words) - {shingle - 1})) AS pos FROM w),
s AS (SELECT DISTINCT doc_id, text, pos, {spelt} AS shingle FROM p),
h AS (SELECT doc_id, text, pos, shingle, template, class, slack, pos - place AS off FROM s JOIN known USING (shingle)),
x AS MATERIALIZED (
  SELECT *, pos // class - back AS win FROM h, (VALUES (0), (1)) AS b(back) WHERE pos + {shingle} <= (pos // class - back + 2) * class),
o AS (SELECT DISTINCT doc_id, text, template, win, off AS low, off + slack AS high FROM x),
v AS (
  SELECT doc_id, text, template, win, low, count(DISTINCT shingle) AS matched, min(pos) AS word_begin, max(pos) + {shingle} AS word_end
  FROM o JOIN x USING (doc_id, text, template, win) WHERE off BETWEEN low AND high GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text, template ORDER BY matched DESC, win, low) AS n
  FROM v JOIN sizes USING (template) WHERE matched >= ceil(size * {containment}))
SELECT doc_id, license_id, matched, size AS template_shingles, round(matched / size, 6) AS containment, word_begin, word_end
FROM r JOIN {names.replace(' AS t(', ' AS names(')} USING (template) WHERE n = 1
"""
