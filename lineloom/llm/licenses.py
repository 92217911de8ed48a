"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame operations only.  Units are the lines of each file, its header (what stands before the first
empty line) and, for files named like a licence, the whole text.  Words are runs of a-z, 0-9 and dots between them, lower-cased.  A word weighs
``tf * (ln((N + 1) / (df + 1)) + 1)``, ``df`` counted over all files, also for the words of no
template, which stand in the norm of a unit.  A unit's licence is that of its most
similar template, if the cosine reaches THRESHOLD; ties go to the smaller name.

Only units that hold an anchor word are compared: a template's anchors are its heaviest words, so
many that the others alone cannot reach THRESHOLD, so no match is lost.

A file without a licence of its own inherits that of the nearest directory above it which holds a
licence file with one (of several files the most similar, then the smaller path).  Directories, not
files, are resolved.  Null texts are empty; files without a path stay without a directory; repeated
paths are one file, whose units are those of all its rows.  Very long texts count whole; an empty table
gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: Public notices by SPDX id.  Fixed values.
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "MIT": ["Released under the MIT License.", "This file is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: What is compared: the notices, and of each licence the line that names it by its id.
TEMPLATES = {name: [*texts, f"SPDX-License-Identifier: {name}"] for name, texts in NOTICES.items()}
_WORD = r"[a-z0-9]+(?:\.+[a-z0-9]+)*"


def words_of(text: Column) -> Column:
    """The words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _template_words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def template_weights(idf: dict[str, float], templates: dict[str, list[str]]) -> list[tuple[str, int, str, float]]:
    """``(licence, template, word, weight)`` with each template of length 1."""
    out = []
    for name, texts in sorted(templates.items()):
        for k, text in enumerate(texts):
            tf = Counter(_template_words(text))
            raw = {w: n * idf[w] for w, n in tf.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            out += [(name, k, w, v / norm) for w, v in sorted(raw.items())]
    return out


def anchors(weights: list[tuple[str, int, str, float]], threshold: float) -> list[str]:
    """Words of which every unit that reaches ``threshold`` holds at least one."""
    out: set[str] = set()
    for key in sorted({(n, k) for n, k, _, _ in weights}):
        rest = 1.0
        for _, w in sorted(((v, w) for n, k, w, v in weights if (n, k) == key), reverse=True):
            if math.sqrt(max(rest, 0.0)) < threshold - 1e-9:
                break
            out.add(w)
            rest -= next(v for n, k, x, v in weights if (n, k, x) == (*key, w)) ** 2
    return sorted(out)


def document_frequency(files: DataFrame) -> DataFrame:
    """``(w, df)``: of every word, the number of rows that hold it; written once."""
    words = F.array_distinct(words_of(F.coalesce("text", F.lit(""))))
    return checkpointed(files.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``(path, licence, similarity)`` of the files of ``files(path, text)`` that carry a licence themselves."""
    spark, templates = files.sparkSession, templates or TEMPLATES
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in _template_words(t)})
    n, held = files.count(), document_frequency(files)
    # As many rows as the templates have words.
    df = {r["w"]: r["df"] for r in held.filter(F.col("w").isin(vocabulary)).collect()}
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    weights = template_weights(idf, templates)
    pattern = "(?:^|[^a-z0-9])(?:" + "|".join(w.replace(".", r"\.") for w in anchors(weights, threshold)) + ")(?:[^a-z0-9]|$)"
    text = F.coalesce("text", F.lit(""))
    whole = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    lines = F.filter(F.concat(F.split(text, "\n"), F.array(F.substring_index(text, "\n\n", 1))), lambda x: F.lower(x).rlike(pattern))
    units = files.filter(F.lower(text).rlike(pattern)).select("path", F.posexplode(F.concat(lines, F.when(whole, F.array(text)).otherwise(F.array()))).alias("unit", "line"), F.monotonically_increasing_id().alias("row"))
    unit = units.select("path", "row", "unit", words_of(F.col("line")).alias("words")).filter(F.size("words") > 0)
    # One row a word of a unit, weighed by the files that hold it, of templates or not.
    counted = unit.select("path", "row", "unit", F.explode("words").alias("w")).groupBy("path", "row", "unit", "w").agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.join(held, "w").select("path", "row", "unit", "w", (F.col("n") * (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1)).alias("v"))
    inside = F.collect_list(F.when(F.col("w").isin(vocabulary), F.struct("w", "v"))).alias("in")
    scored = weighed.groupBy("path", "row", "unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), inside)
    scored = scored.select("path", "row", "unit", "norm", F.explode("in").alias("t")).select("path", "row", "unit", "norm", F.col("t.w").alias("w"), F.col("t.v").alias("v"))
    # As many rows as the templates have words.
    table = spark.createDataFrame(weights, "licence string, template int, w string, weight double")
    cosine = scored.join(F.broadcast(table), "w").groupBy("path", "row", "unit", "licence", "template").agg((F.sum(F.col("v") * F.col("weight")) / F.max("norm")).alias("cosine"))
    similar = F.round("cosine", 6)
    best = cosine.filter(similar >= threshold).groupBy("path").agg(F.min(F.struct((-similar).alias("apart"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.apart")).alias("similarity"))


def directory(path: Column) -> Column:
    """The directory of a path; the top is the empty string."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """``(path, licence, similarity, origin, origin_dir)`` of every distinct path of ``files``."""
    paths = files.select("path").distinct().withColumn("dir", directory(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    holders = own.filter(name.rlike(LICENCE_FILE)).withColumn("dir", directory(F.col("path")))
    granted = holders.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "licence")).alias("g")).select(F.col("dir").alias("origin_dir"), F.col("g.licence").alias("granted"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = paths.select("dir").distinct().filter(F.col("dir").isNotNull()).select("dir", F.explode(F.array_distinct(above)).alias("origin_dir"))
    nearest = up.join(granted, "origin_dir").groupBy("dir").agg(F.max(F.struct(F.length("origin_dir").alias("depth"), "origin_dir", "granted")).alias("n")).select("dir", F.col("n.origin_dir").alias("origin_dir"), F.col("n.granted").alias("granted"))
    out = paths.join(own, "path", "left").join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    origin = F.when(has, "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("licence", "granted").alias("licence"), F.col("similarity"), origin.alias("origin"), F.when(~has, F.col("origin_dir")).alias("origin_dir"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The licence of every distinct path of ``files(path, text)``."""
    # Cut off: it is used twice, and making it reads every text.
    return inherit(files, checkpointed(own_licences(files, threshold)))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, shelf, name; one in ten is named as a licence file, one in five of these a level up.  Rows of one id, source and language are one file."""
    shelf = F.concat(F.lit("shelf"), F.pmod("doc_id", F.lit(20)).cast("string"))
    folder = F.when(F.pmod("doc_id", F.lit(50)) == 0, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", "source", "lang", shelf))
    name = F.concat(F.when(F.pmod("doc_id", F.lit(10)) == 0, F.lit("LICENSE.")).otherwise(F.lit("d.")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return documents.select(F.concat_ws("/", folder, name).alias("path"), "text")


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited; see :func:`as_files` for the paths."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(as_files(documents)).select(F.regexp_extract("path", r"\.([^./]+)$", 1).try_cast("long").alias("doc_id"), "path", "licence", "similarity", "origin", "origin_dir")


def _sql() -> str:
    """The query in DuckDB's SQL: every line and licence file compared with every template that shares a word, all words weighed by their document frequency."""
    rows = ", ".join("('" + "', '".join((n, str(k), t.replace("'", "''"))) + "')" for n, ts in sorted(TEMPLATES.items()) for k, t in enumerate(ts))
    words = "unnest(regexp_extract_all(lower({}), '" + _WORD + "'))"
    return f"""WITH files AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN source || '/' || lang ELSE source || '/' || lang || '/shelf' || (doc_id % 20) END AS dir,
    CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' ELSE 'd.' END || doc_id AS name FROM documents),
  tpl(licence, template, text) AS (VALUES {rows}), tw AS (SELECT licence, template, {words.format("text")} AS w FROM tpl), vocab AS (SELECT DISTINCT w FROM tw),
  held AS (SELECT doc_id, {words.format("text")} AS w FROM files), total AS (SELECT count(*) AS n FROM files),
  df AS (SELECT w, count(DISTINCT doc_id) AS df FROM held GROUP BY w),
  idf AS (SELECT w, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT w FROM df UNION SELECT w FROM vocab) LEFT JOIN df USING (w), total),
  raw AS (SELECT licence, template, w, count(*) * any_value(idf) AS v FROM tw JOIN idf USING (w) GROUP BY licence, template, w),
  weights AS (SELECT licence, template, w, v / sqrt(sum(v * v) OVER (PARTITION BY licence, template)) AS weight FROM raw),
  units AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS unit, unnest(string_split(text, chr(10))) AS line FROM files
    UNION ALL SELECT doc_id, 0, text FROM files WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, -1, string_split(text, chr(10) || chr(10))[1] FROM files),
  uw AS (SELECT doc_id, unit, {words.format("line")} AS w FROM units), tf AS (SELECT doc_id, unit, w, count(*) AS tf FROM uw GROUP BY ALL),
  v AS (SELECT doc_id, unit, w, tf * idf AS v, pow(tf * idf, 2) AS part FROM tf JOIN idf USING (w)),
  norms AS (SELECT doc_id, unit, sqrt(sum(part)) AS norm FROM v GROUP BY ALL),
  cosine AS (SELECT doc_id, unit, licence, template, sum(v.v * weight) AS dot FROM v JOIN weights USING (w) GROUP BY ALL),
  own AS (SELECT doc_id, licence, round(dot / norm, 6) AS similarity FROM cosine JOIN norms USING (doc_id, unit) WHERE round(dot / norm, 6) >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / norm, 6) DESC, licence) = 1),
  granted AS (SELECT dir AS origin_dir, licence AS granted FROM own JOIN files USING (doc_id) WHERE doc_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, dir || '/' || name) = 1),
  near AS (SELECT f.doc_id, g.origin_dir, g.granted FROM files f JOIN granted g ON f.dir = g.origin_dir OR starts_with(f.dir, g.origin_dir || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(g.origin_dir) DESC) = 1)
SELECT doc_id, dir || '/' || name AS path, coalesce(licence, granted) AS licence, similarity, CASE WHEN licence IS NOT NULL THEN 'own' WHEN granted IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN licence IS NULL THEN origin_dir END AS origin_dir FROM files LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)"""


SQL = _sql()
