"""License scans: headers and licence files by sparse TF-IDF cosine to templates,
inherited along directories.  DataFrame functions only.

A licence file is one whose whole text is like a licence's full text (the texts
in ``licenses/``).  A header is a window over a file's words, across lines and
inside of lines, as long as a notice and like it.  A window is looked at where
a term of the file meets the same term of the notice, for the terms without
which no text can reach the threshold (by Cauchy-Schwarz on the notice's
weights).  Equal texts and equal windows are compared once.  A file without a
licence of its own takes that of the nearest directory above it that holds a
licence file.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.store import Scratch

# Notices as they are commonly written.
HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
}
HEADER_SIMILARITY = 0.8
FILE_SIMILARITY = 0.8
_NOT_TERM = "[^a-z0-9]+"


def full_texts() -> dict[str, list[str]]:
    """The licences' full texts (read by the driver)."""
    return {f.stem: [f.read_text(encoding="utf-8")] for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def terms(text: str) -> list[str]:
    return [t for t in re.split(_NOT_TERM, text.lower()) if t]


class Weights:
    """The templates' unit vectors and the inverse document frequencies of their terms.

    ``often`` says in how many of ``total`` files each term occurs; a term of no
    template counts as one that no file holds.
    """

    def __init__(self, templates: dict[str, list[str]], often: dict[str, int], total: int):
        self.words = [terms(text) for texts in templates.values() for text in texts]
        counted = [(name, Counter(terms(text))) for name, texts in templates.items() for text in texts]
        self.idf = {t: math.log((1 + total) / (1 + often.get(t, 0))) + 1 for _, c in counted for t in c}
        self.unseen = math.log(1 + total) + 1
        self.vectors = []
        for name, c in counted:
            raw = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append((name, {t: x / norm for t, x in raw.items()}))

    def needed(self, similarity: float) -> list[str]:
        """Terms of which a text must hold one to reach ``similarity`` with any template."""
        found = set()
        for _, vector in self.vectors:
            rest = 1.0
            for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if rest < similarity * similarity * (1 - 1e-9):
                    break
                found.add(t)
                rest -= w * w
        return sorted(found)


def _array(values: list[str]) -> Column:
    """A constant array of terms."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def _words(text) -> Column:
    return F.array_remove(F.split(F.lower(text), _NOT_TERM), "")


def windows(words: Column, weights: Weights, similarity: float) -> Column:
    """The stretches of a text's words that are as long as a template and line up one of its needed terms with that
    term's place in the template (distinct, each as text)."""
    needed = weights.needed(similarity)
    places = [{"term": t, "at": i, "size": len(w)} for w in weights.words for i, t in enumerate(w) if t in needed]
    anchors = F.from_json(F.lit(json.dumps(places)), "array<struct<term: string, at: int, size: int>>")
    met = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("i"))), lambda h: F.array_contains(_array(needed), h["term"]))
    each = F.transform(met, lambda h: F.transform(F.filter(anchors, lambda a: a["term"] == h["term"]), lambda a: F.array_join(
        F.slice(words, F.greatest(h["i"] - a["at"], F.lit(0)) + 1, a["size"]), " ")))
    return F.array_distinct(F.flatten(each))


def similar(units: DataFrame, weights: Weights, scratch: Scratch, name: str) -> DataFrame:
    """key, license and score (the best cosine) of texts (key, unit) that share a term with a template."""
    spark = units.sparkSession
    counts = units.select("key", F.explode(_words("unit")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    # one row per template term: bounded by the templates
    idf = spark.createDataFrame(sorted(weights.idf.items()), "term string, idf double")
    vectors = spark.createDataFrame([(i, name, t, w) for i, (name, v) in enumerate(weights.vectors) for t, w in sorted(v.items())],
                                    "template int, license string, term string, weight double")
    weighed = scratch.write(counts.join(F.broadcast(idf), "term", "left")
                            .select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(weights.unseen))).alias("w")), f"{name}-weighed")
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = F.max(F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("score"), (-F.col("template")).alias("first"), F.col("license").alias("license")))
    return dots.join(norms, "key").groupBy("key").agg(best.alias("b")).select("key", "b.license", "b.score", "b.first")


def scan(files: DataFrame, carry: list[str] | None = None, headers: dict[str, list[str]] | None = None,
         full: dict[str, list[str]] | None = None, header: float = HEADER_SIMILARITY, whole: float = FILE_SIMILARITY) -> DataFrame:
    """path, license, how (``file``, ``header``, ``inherited``), score, licensed_by, and the carried columns, a row for
    every row (also repeated ones and those with equal paths).

    A file that is a licence file has that licence; else its best header counts
    (of equal scores the template that comes first).  Null and empty texts have
    no licence of their own but may inherit one; rows without path inherit
    none.  Among a directory's licence files the best score wins, then the
    smallest path.  licensed_by is the licence file of an inherited licence.
    An empty table gives no rows.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    headers, full, carry = HEADERS if headers is None else headers, full_texts() if full is None else full, carry or []
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"__{c}") for c in carry))
    vocabulary = sorted({t for templates in (headers, full) for texts in templates.values() for text in texts for t in terms(text)})
    held = F.array_intersect(_words("text"), _array(vocabulary))
    # a row per template term, and the number of files
    often = rows.select(F.explode(F.array_append(held, F.lit(""))).alias("term")).groupBy("term").count().collect()
    often = {r["term"]: r["count"] for r in often}
    total = often.pop("", 0)
    notices, licence_texts = Weights(headers, often, total), Weights(full, often, total)

    def holds(weights: Weights, similarity: float) -> Column:
        return F.arrays_overlap(_words("text"), _array(weights.needed(similarity)))

    texts = rows.where(holds(notices, header) | holds(licence_texts, whole)).select("text").withColumn("key", F.md5("text"))
    texts = scratch.write(texts.dropDuplicates(["key"]), "texts")
    as_files = similar(texts.where(holds(licence_texts, whole)).select("key", F.col("text").alias("unit")), licence_texts, scratch, "files") \
        .where(F.col("score") >= whole).select("key", "license", "score", F.lit("file").alias("how"))
    each = texts.select(F.col("key").alias("of"), F.explode(windows(_words("text"), notices, header)).alias("unit")).withColumn("key", F.md5("unit"))
    each = scratch.write(each, "windows")
    found = similar(each.select("key", "unit").dropDuplicates(["key"]), notices, scratch, "headers").where(F.col("score") >= header)
    as_headers = each.select("key", "of").join(found, "key").groupBy("of") \
        .agg(F.max(F.struct("score", "first", "license")).alias("b")).select(F.col("of").alias("key"), "b.license", "b.score", F.lit("header").alias("how"))
    best = F.min_by(F.struct("license", "score", "how"), "how").alias("b")  # a file before a header
    own = scratch.write(as_files.union(as_headers).groupBy("key").agg(best).select("key", "b.*"), "own")

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    placed = scratch.write(rows.select("path", F.md5("text").alias("key"), *(f"__{c}" for c in carry)).join(own, "key", "left").drop("key")
                           .withColumn("folder", folder), "placed")
    first = F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("f")
    licences = scratch.write(placed.where("how = 'file' and path is not null").groupBy(F.col("folder").alias("above")).agg(first)
                             .select("above", "f.license", (-F.col("f.s")).alias("score"), F.col("f.path").alias("by")), "licences")
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    climbs = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))), up)  # the top folder is above all
    folders = placed.where("folder is not null").select("folder").distinct().select("folder", F.explode(climbs).alias("u")).select("folder", "u.*")
    nearest = folders.join(licences, "above").groupBy("folder").agg(F.max(F.struct("depth", "license", "score", "by")).alias("n"))
    nearest = nearest.select("folder", F.col("n.license").alias("license_above"), F.col("n.score").alias("score_above"), F.col("n.by").alias("by"))
    said = placed.join(scratch.write(nearest, "nearest"), "folder", "left")
    inherits = F.col("license").isNull() & F.col("license_above").isNotNull()
    return said.select("path", F.coalesce("license", "license_above").alias("license"), F.when(inherits, "inherited").otherwise(F.col("how")).alias("how"),
                       F.coalesce("score", "score_above").alias("score"), F.when(inherits, F.col("by")).alias("licensed_by"),
                       *(F.col(f"__{c}").alias(c) for c in carry))
