"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines of files, and licence files also as a whole, are compared with the templates. Whether a line can reach the
threshold at all is decided first, by the terms that carry a template's weight: a line without any of
them stays below it, whatever else it holds. So only such lines are ever taken apart. Everything runs
in DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

#: Notices by licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-rights-reserved", "All rights reserved."),
)
LEAST = 0.6
_LICENCE_NAME = r"(?i)^(licen[cs]e|copying|copyright|notice)\b"


def _terms(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def _words(text: Column) -> Column:
    return F.split(F.lower(text), "[^a-z0-9]+")


def template_weights(templates, documents: int, found: dict[str, int]) -> list[dict[str, float]]:
    """Per template its terms' weights, of length 1 together; ``found``: documents with a term."""
    out = []
    for _, text in templates:
        w = {t: n * (math.log((documents + 1) / (found.get(t, 0) + 1)) + 1) for t, n in Counter(_terms(text)).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / size for t, x in w.items()})
    return out


def anchors(weights: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which a text must have one to reach the cosine: the others of a template together
    stay below it."""
    out: set[str] = set()
    for w in weights:
        rest = 0.0
        for t, x in sorted(w.items(), key=lambda kv: (kv[1], kv[0])):
            if rest + x * x >= least * least:
                out.add(t)
            else:
                rest += x * x
    return sorted(out)


def ancestors(directory: Column) -> Column:
    """The directory and all above it, up to the root, ''."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, least: float = LEAST,
                  licence_file: Column | None = None) -> DataFrame:
    """One row per row of ``files``: path, license, score, origin.

    ``origin`` is ``file`` for a licence file (by its name, or as ``licence_file`` says) whose whole
    text or one line of it matches, ``header`` for another file with a matching line, ``inherited``
    where the nearest directory above with a matching licence file gives it, else null, as are ``license`` and
    ``score`` then. The best cosine of at least ``least`` counts; ties go to the template named
    first. A directory with several licence files takes the best match, then the smallest path. A
    null text matches nothing; a null path has no directory; repeated rows are rows of their own.
    Other columns are not read; an empty table gives no rows. Only one number per template term
    reaches the driver.
    """
    spark = files.sparkSession
    licence_file = F.regexp_extract(path, r"[^/]*$", 0).rlike(_LICENCE_NAME) if licence_file is None else licence_file
    given = files.select(F.col(path).alias("path"), F.col(text).alias("text"), F.coalesce(licence_file, F.lit(False)).alias("is_file"))
    vocabulary = sorted({t for _, x in templates for t in _terms(x)})
    met = given.select(F.explode(F.array_intersect(_words(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("term"))
    found = {r[0]: r[1] for r in met.groupBy("term").count().collect()}  # at most the vocabulary
    documents = given.count()
    weights = template_weights(templates, documents, found)
    unseen = math.log(documents + 1) + 1
    table = spark.createDataFrame([(t, math.log((documents + 1) / (found.get(t, 0) + 1)) + 1, [w.get(t, 0.0) for w in weights]) for t in vocabulary],
                                  "word string, idf double, weights array<double>")
    telling = rf"(?i)(?<![a-z0-9])(?:{'|'.join(anchors(weights, least))})(?![a-z0-9])"
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(telling))
    none = F.array().cast("array<string>")
    units = F.when(F.col("text").isNull() | ~F.col("text").rlike(telling), none).when(
        F.col("is_file"), F.array_distinct(F.concat(F.array("text"), lines))).otherwise(lines)
    held = rows.land(given.select(F.monotonically_increasing_id().alias("row"), "path", "is_file",
                                  F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+", "/").alias("dir"), units.alias("units")), "units")
    # Term counts of each unit, weighted; dot products with all templates in one pass.
    words = held.select("row", F.posexplode("units").alias("unit", "said")).select("row", "unit", F.explode(_words(F.col("said"))).alias("word")).filter(
        "word != ''").groupBy("row", "unit", "word").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(table), "word", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    dots = words.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), *[
        F.sum(F.col("w") * F.coalesce(F.col("weights")[k], F.lit(0.0))).alias(f"dot{k}") for k in range(len(templates))])
    each = F.array(*[F.struct(F.round(F.col(f"dot{k}") / F.col("size"), 6).alias("score"), F.lit(-k).alias("turn"), F.lit(name).alias("license"))
                     for k, (name, _) in enumerate(templates)])
    best = dots.select("row", F.array_max(each).alias("best")).groupBy("row").agg(F.max("best").alias("best")).filter(F.col("best.score") >= least)
    files_ = rows.land(held.drop("units").join(best, "row", "left"), "own")
    owners = files_.filter("is_file and best is not null and path is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("best.score")).alias("minus"), "path", F.col("best.license").alias("license"))).alias("own")).select(
        F.col("dir").alias("at"), "own.license", (-F.col("own.minus")).alias("score"))
    # Directories, not files, look for their ancestors, so that a directory with many files asks once.
    asked = files_.filter("best is null and path is not null").select("dir").distinct()
    # Landed, so that the last join can split a directory with very many files or send its few rows round.
    given_down = rows.land(asked.select("dir", F.explode(ancestors(F.col("dir"))).alias("at")).join(owners, "at").groupBy("dir").agg(
        F.max(F.struct(F.length("at").alias("depth"), "license", "score")).alias("down")), "inherited")
    own, down = F.col("best").isNotNull(), F.col("down").isNotNull() & F.col("path").isNotNull()
    return files_.join(given_down, "dir", "left").select(
        "path", F.when(own, F.col("best.license")).when(down, F.col("down.license")).alias("license"),
        F.when(own, F.col("best.score")).when(down, F.col("down.score")).alias("score"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(down, "inherited").alias("origin"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents. A source is a directory of English texts with one below it for each
    other language; a text of at most 300 characters is taken for a notice about its directory."""
    docs = rows.table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", F.when(F.col("lang") != "en", F.col("lang")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.withColumn("path", place), licence_file=F.length("text") <= 300)


_VALUES = ", ".join(f"({k}, '{name}', '{text.lower()}')" for k, (name, text) in enumerate(TEMPLATES))
OP4_SQL = rf"""
WITH files AS (SELECT concat_ws('/', source, CASE WHEN lang <> 'en' THEN lang END, doc_id || '.txt') AS path,
  concat_ws('/', source, CASE WHEN lang <> 'en' THEN lang END) AS dir, coalesce(length(text) <= 300, false) AS is_file, text, doc_id FROM documents),
templates AS (SELECT * FROM (VALUES {_VALUES}) t(k, license, notice)),
tterms AS (SELECT k, license, term, count(*) AS tf FROM (SELECT k, license, unnest(string_split_regex(notice, '[^a-z0-9]+')) AS term FROM templates) WHERE term <> '' GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM tterms),
total AS (SELECT count(*) AS n FROM files),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM files) JOIN vocabulary USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN df USING (term), total),
tweights AS (SELECT k, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS tw FROM tterms JOIN idf USING (term)),
units AS (SELECT path, is_file, text AS said, 0 AS unit FROM files WHERE is_file
  UNION ALL SELECT path, is_file, u.said, u.unit FROM (SELECT path, is_file, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM files) u),
uterms AS (SELECT path, unit, term, count(*) AS tf FROM (SELECT path, unit, unnest(string_split_regex(lower(said), '[^a-z0-9]+')) AS term FROM units) WHERE term <> '' GROUP BY ALL),
uweights AS (SELECT path, unit, term, tf * coalesce(idf, ln(n + 1) + 1) AS w FROM uterms LEFT JOIN idf USING (term), total),
sizes AS (SELECT path, unit, sqrt(sum(w * w)) AS size FROM uweights GROUP BY ALL),
scores AS (SELECT path, k, license, round(sum(w * tw) / any_value(size), 6) AS score FROM uweights JOIN tweights USING (term) JOIN sizes USING (path, unit) GROUP BY path, unit, k, license),
best AS (SELECT path, license, score FROM scores WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, k) = 1),
owners AS (SELECT dir, license, score FROM files JOIN best USING (path) WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
above AS (SELECT f.path, o.license, o.score FROM files f JOIN owners o ON f.dir = o.dir OR starts_with(f.dir, o.dir || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(o.dir) DESC) = 1)
SELECT f.path, coalesce(b.license, a.license) AS license, coalesce(b.score, a.score) AS score,
  CASE WHEN b.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN a.license IS NOT NULL THEN 'inherited' END AS origin
FROM files f LEFT JOIN best b USING (path) LEFT JOIN above a USING (path)
"""
