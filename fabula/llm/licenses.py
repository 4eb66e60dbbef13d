"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment confirms.

Texts and templates become word shingles (5 words, hashed). A long template is cut into segments of `SEGMENT` shingles;
texts are read in windows of `WINDOW` shingles, one every `STRIDE`, so that every occurrence of a segment lies whole in
some window. The one-permutation MinHash of a window keeps the least hash in each of `BANDS` ranges of the hash
space, and each of these is a band. A segment of 8 shingles among a window's 20 shares a given occupied band with odds of about 0.7, and
occupies six or seven of 16, so a window misses a segment with odds below 0.001, and a template has several segments.
A template of fewer than `SEGMENT` shingles fills no window's bands reliably, so its windows are one shingle long and their
only band is that shingle, which is found with certainty.

Whatever a key retrieves is confirmed exactly: the template's distinct shingles are intersected with those of the whole
text, and a match needs at least `CONTAINED` of them. DataFrame functions only; the templates are a parameter and become
constants of the plan.

Defined cases: a null, empty or wordless text has no matches; templates without words are ignored; a template shorter
than a shingle is one shingle; equal document rows (doc_id and text) give a match once; very long texts are read whole
within their row; templates that tie are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import ALNUM_BREAKS, let, words

SHINGLE = 5
SEGMENT = 8
WINDOW, STRIDE = 20, 12
BANDS_BITS = 4
CONTAINED = 0.8

# Notices as their licenses word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "mit": "Released under the MIT License",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
}


def _grams(h: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))


def _least_by_band(g: Column) -> Column:
    """The least hash in each occupied range of the hash space: in a sorted array, whatever starts a new range."""
    band = lambda x: F.shiftright(x, 64 - BANDS_BITS)
    return let(F.sort_array(g), lambda s: F.filter(s, lambda x, i: (i == 0) | (band(x) != band(F.get(s, i - 1)))))


def _bands(g: Column) -> Column:
    """The band keys of the windows over a text's shingles."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0)), F.lit(STRIDE))
    return F.flatten(F.transform(starts, lambda i: _least_by_band(F.slice(g, i + 1, F.lit(WINDOW)))))


def templates(spark: SparkSession, named: dict[str, str] | None = None) -> DataFrame:
    """license, template (distinct shingle hashes), n, width (words in a shingle) and key, a row for each key that retrieves it."""
    rows = spark.createDataFrame(list((named or TEMPLATES).items()), "license string, text string")
    rows = rows.select("license", words(F.col("text"), ALNUM_BREAKS).alias("ws")).filter(F.size("ws") > 0)
    rows = rows.select("license", F.transform("ws", lambda w: F.xxhash64(w)).alias("h"), F.least(F.size("ws"), F.lit(SHINGLE)).alias("width"))
    ordered = F.coalesce(*[F.when(F.col("width") == n, _grams(F.col("h"), n)) for n in range(1, SHINGLE + 1)])
    rows = rows.select("license", "width", ordered.alias("ordered")).withColumn("template", F.array_distinct("ordered"))
    segments = F.transform(F.sequence(F.lit(0), F.size("ordered") - SEGMENT), lambda i: _least_by_band(F.slice("ordered", i + 1, F.lit(SEGMENT))))
    keys = F.when(F.size("ordered") >= SEGMENT, F.array_distinct(F.flatten(segments))).otherwise(F.col("template"))
    return rows.select("license", "template", F.size("template").alias("n"), "width", F.explode(keys).alias("key"))


def scan(docs: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    """A row for each document and template that it holds: doc_id, text_hash, license, first_word, containment.

    Retrieval and containment stay within a document's row: its shingles are computed once for each width, and only matches leave the row."""
    # the templates came from the driver as a parameter, so their keys may return to it
    listed = templates(docs.sparkSession, named).groupBy("license", "width", "n", "template").agg(F.collect_set("key").alias("keys")).orderBy("license").collect()

    def held(h: Column) -> Column:
        """(license, first_word, containment) of every template that a text's windows retrieve and its shingles contain."""
        none = F.array().cast("array<struct<license:string,first_word:int,containment:double>>")

        def of_width(n: int) -> Column:
            mine = [r for r in listed if r.width == n]
            known = F.array(*[F.struct(F.lit(r.license).alias("license"), F.lit(r.n).alias("n"), _literal(r.template).alias("template"), _literal(r.keys).alias("keys")) for r in mine])
            every = _literal(sorted({k for r in mine for k in r.keys}))
            seen = (lambda g: F.concat(g, _bands(g))) if n == SHINGLE else (lambda g: g)

            def contained(g: Column, hit: Column) -> Column:
                retrieved = F.filter(known, lambda t: F.arrays_overlap(t["keys"], hit))
                shared = F.transform(retrieved, lambda t: F.struct(t["license"].alias("license"), t["n"].alias("n"), F.array_intersect(g, t["template"]).alias("both")))
                enough = F.filter(shared, lambda t: F.size(t["both"]) >= CONTAINED * t["n"])
                return F.transform(enough, lambda t: F.struct(
                    t["license"].alias("license"), (F.array_min(F.transform(t["both"], lambda x: F.array_position(g, x))) - 1).cast("int").alias("first_word"), (F.size(t["both"]) / t["n"]).alias("containment")))

            found = let(_grams(h, n), lambda g: let(F.array_intersect(seen(g), every), lambda hit: F.when(F.size(hit) > 0, contained(g, hit)).otherwise(none)))
            return F.when(F.size(h) >= n, found).otherwise(none)

        return F.concat(none, *[of_width(n) for n in sorted({r.width for r in listed})])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text"), ALNUM_BREAKS).alias("ws"))
    return rows.select("doc_id", "text_hash", F.inline(let(F.transform("ws", lambda w: F.xxhash64(w)), held))).distinct()


def _literal(keys: list[int]) -> Column:
    """The keys as one constant array."""
    return F.split(F.lit(",".join(map(str, keys))), ",").cast("array<bigint>")


def digest(docs: DataFrame, named: dict[str, str] | None = None) -> DataFrame:
    return scan(docs, named).select("doc_id", "license", "containment").distinct()


def oracle(named: dict[str, str] | None = None) -> str:
    """DuckDB SQL for digest(): the share of each template's shingles that a text holds."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (named or TEMPLATES).items())
    ws = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT license, {ws} AS ws FROM (VALUES {values}) AS v(license, text)),
g AS (SELECT DISTINCT license, least(5, len(ws)) AS k, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT license, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT license, count(*) AS n FROM g GROUP BY license),
d AS (SELECT doc_id, {ws} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k))
SELECT doc_id, license, count(*) / any_value(n)::DOUBLE AS containment
FROM s JOIN g USING (k, g) JOIN n USING (license) GROUP BY doc_id, license HAVING count(*) >= 0.8 * any_value(n)
"""
