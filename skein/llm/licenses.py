"""Licences of files by notices in their lines and by the licence files of their directories, with DataFrame functions.

Every line of a text is compared with the templates by the cosine of sparse TF-IDF vectors; the best line of a file
decides. Where no line does, every window of as many words as a template has is compared, over the whole text and across
its line ends, so wrapped notices and notices beside other words on their line are found; a text shorter than a template is
one window. A window can be chosen freely, so it must agree more than a line, and one of few words wholly. Inverse document frequencies are those of the
templates; a word no template knows has the highest. Only lines and windows with a word without which no template's cosine
can reach the threshold, and whose own words leave it in reach, are taken apart; this loses nothing. Texts are cut into words
once, where they lie; only such lines and windows are written and shuffled, never whole texts.

Files named like licence files license their directory. A file without a notice of its own inherits from the nearest
directory above it: directories are joined with the licensed directories by all their ancestors, then files with their directory.

Defined results: a null or empty text has no notice; a null path inherits nothing; of equal scores the first licence
by name holds; a licence file at the root ("/") licenses all below, one without any folder only itself; repeated rows are answered alike; a file that nothing licenses has null in every result column; an
empty table of files or templates gives no licences. Other columns are kept; result names replace them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage

LEAST_COSINE = 0.6
LEAST_WINDOW = 0.7
SHORT_WINDOW, LEAST_SHORT = 5, 0.95  # windows of fewer words: "all rights" and any third word reach 0.77
MOST_LITERALS = 5_000  # template words up to which a line is bounded before it is taken apart
MOST_TEMPLATE_WORDS = 100_000  # more template words than this are joined by a shuffle
#: Words of everyday prose, the most frequent last; of those that would do, lines and windows are looked for by other words.
COMMON = "under can may any free met mit not from you for it or on all are by is with to in this be as that a of and the".split()
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)\b"

#: Fixed texts of common notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def template_vectors(templates: DataFrame) -> DataFrame:
    """(template, license, token, idf, weight): unit vectors of the distinct texts of a licence."""
    texts = templates.where(F.col("license").isNotNull() & F.col("text").isNotNull()).select("license", "text").distinct()
    words = texts.select(F.xxhash64("license", "text").alias("template"), "license", F.explode(tokens(F.col("text"))).alias("token"))
    counted = words.groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    size = counted.agg(F.count_distinct("template").alias("n"))
    idf = counted.groupBy("token").agg(F.count_distinct("template").alias("df")).join(F.broadcast(size)).select(  # one row
        "token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counted.join(idf, "token").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("template")))
    return raw.select("template", "license", "token", "idf", (F.col("raw") / norm).alias("weight"))


def needed_words(vectors: list, least: float, last: list[str] = ()) -> list[str]:
    """Words of which a line must have one: without all of them no template's cosine can reach ``least``.

    Words of ``last`` are only taken where the others do not do.
    """
    rank = {w: k for k, w in enumerate(last)}
    by_template: dict[int, list] = {}
    for r in vectors:
        by_template.setdefault(r["template"], []).append(r)
    out: set[str] = set()
    for rows in by_template.values():
        rest = 1.0 - sum(r["weight"] ** 2 for r in rows if r["token"] in out)
        for r in sorted(rows, key=lambda r: (rank.get(r["token"], -1), -len(r["token"]), r["token"])):  # long words are rare in prose
            if rest < (least - 1e-9) ** 2:
                break
            if r["token"] not in out:
                out.add(r["token"])
                rest -= r["weight"] ** 2
    return sorted(out)


def could_reach(words: Column, vectors: list, n: int, least: float) -> Column:
    """Whether the cosine of a line to some template can reach ``least``.

    The product with a template is exact; the norm of the line is at least that of its words taken once each.
    """
    order = {t: k for k, t in enumerate(sorted({r["template"] for r in vectors}))}
    gains: dict[str, list[float]] = {}
    for r in vectors:
        gains.setdefault(r["token"], [r["idf"], *[0.0] * len(order)])[order[r["template"]] + 1] = r["idf"] * r["weight"]
    table = F.from_json(F.lit(json.dumps(gains)), "map<string,array<double>>")
    none = F.array_repeat(F.lit(0.0), len(order) + 1)
    unknown = math.log(n + 1) + 1

    def of(known: Column) -> Column:
        found = F.transform(known, lambda w: F.try_element_at(table, w))
        sums = F.aggregate(found, none, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        norm = F.sqrt(F.aggregate(found, (F.size(words) - F.size(known)) * unknown ** 2, lambda acc, v: acc + v[0] * v[0]))
        return F.array_max(F.slice(sums, 2, len(order))) >= norm * (least - 1e-6)
    return F.exists(F.array(F.filter(words, lambda w: w.isin(*gains))), of)  # a hash set; the table is searched in line


def lines(text: Column, wanted: list[str], reaches: Callable[[Column], Column]) -> Column:
    """(_line, _window, _tokens) of the lines that hold a wanted word and reach."""
    taken = F.transform(F.split(text, "\n"), lambda line, k: F.struct(
        k.cast("bigint").alias("_line"), F.lit(False).alias("_window"), tokens(line).alias("_tokens")))
    return F.filter(taken, lambda r: F.exists(r["_tokens"], lambda w: w.isin(*wanted)) & reaches(r["_tokens"]))


def anchored(tok: Column, wanted: list[str], most: int) -> Column:
    """For every wanted word at place ``p`` of a text of ``n`` words: the words from ``lo`` on of windows in which it is the first."""
    def around(at: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            lo = F.greatest(F.coalesce(F.get(at, k - 1), F.lit(0)) + 1, p - most + 1)
            return F.struct(lo.alias("lo"), p.alias("p"), F.size(tok).alias("n"), F.slice(tok, lo, p - lo + most).alias("words"))
        return F.transform(at, one)
    places = F.filter(F.transform(tok, lambda w, k: F.when(w.isin(*wanted), k + 1)), lambda p: p.isNotNull())
    return F.flatten(F.transform(F.array(places), around))


def windows(anchor: Column, lengths: list[int]) -> Column:
    """(_line, _window, _tokens) of the windows of an anchor; ``_line`` numbers the windows of a file."""
    lo, p, n, words = (anchor[c] for c in ("lo", "p", "n", "words"))

    def of(size: Column) -> Column:
        first, last = F.greatest(lo, p - size + 1), F.least(p, F.greatest(n - size + 1, F.lit(1)))
        starts = F.filter(F.sequence(first, F.greatest(first, last)), lambda s: s <= last)
        return F.transform(starts, lambda s: F.struct(
            (s.cast("bigint") * (max(lengths) + 1) + size).alias("_line"), F.lit(True).alias("_window"), F.slice(words, s - lo + 1, size).alias("_tokens")))
    return F.flatten(F.transform(F.array(*map(F.lit, lengths)), of))


def candidates(files: DataFrame, vectors: list, n: int, lengths: list[int], least: float, least_window: float) -> DataFrame:
    """(_file, _line, _window, _tokens) of the lines and windows that can reach the least cosine, without a shuffle."""
    wanted, rare = needed_words(vectors, least, COMMON), needed_words(vectors, least_window, COMMON)

    def reaches(least: float) -> Callable[[Column], Column]:
        # more template words are not held against every line: more lines are taken apart, with the same result
        return (lambda words: could_reach(words, vectors, n, least)) if len(vectors) <= MOST_LITERALS else (lambda words: F.lit(True))

    def of(tok: Column) -> Column:
        own = F.when(F.exists(tok, lambda w: w.isin(*wanted)), lines(F.col("text"), wanted, reaches(least)))
        around = F.transform(anchored(tok, rare, max(lengths)), lambda a: F.filter(
            windows(a, lengths), lambda r: reaches(least_window)(r["_tokens"])))
        return F.concat(F.array(F.coalesce(own, F.array())), around)
    return files.select("_file", F.explode(F.flatten(F.transform(F.array(tokens(F.col("text"))), of))).alias("_found")) \
        .select("_file", F.inline("_found"))


def notices(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE, least_window: float = LEAST_WINDOW) -> DataFrame:
    """(_file, license, score) of the files with a notice. ``files``: _file, text."""
    vectors = cut_lineage(template_vectors(templates))
    known = vectors.collect()  # of the size of the templates
    if not known:
        return files.select("_file", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("score")).limit(0)
    least_window = max(least, least_window)
    n = len({r["template"] for r in known})
    lengths = sorted({r["n"] for r in templates.where(F.col("license").isNotNull()).select(F.size(tokens(F.col("text"))).alias("n")).distinct().collect()
                      if r["n"] and r["n"] > 0})
    idf = vectors.groupBy("token").agg(F.first("idf").alias("idf"))
    small = len(known) <= MOST_TEMPLATE_WORDS
    ship = F.broadcast if small else (lambda df: df)

    def best_of(lines: DataFrame, enough: Column) -> DataFrame:
        """Best licence of every file of ``lines`` (_file, _line, _tokens)."""
        counted = (lines.select("_file", "_line", F.explode("_tokens").alias("token"))
                   .groupBy("_file", "_line", "token").agg(F.count("*").alias("tf")))
        raw = counted.join(ship(idf), "token", "left").withColumn(
            "raw", F.col("tf") * F.coalesce("idf", F.log(F.lit(n + 1.0)) + 1))
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("_file", "_line")))
        scored = (raw.withColumn("_norm", norm).join(ship(vectors.select("template", "license", "token", "weight")), "token")
                  .groupBy("_file", "_line", "template", "license")
                  .agg((F.sum(F.col("raw") * F.col("weight")) / F.first("_norm")).alias("score")).where(F.col("score") >= enough))
        best = F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("license").alias("license"), F.col("score").alias("score")))
        return scored.groupBy("_file").agg(best.alias("_best")).select("_file", "_best.license", "_best.score")

    looked_at = cut_lineage(candidates(files, known, n, lengths, least, least_window).distinct())  # rows with the same path and text are one file
    found = cut_lineage(best_of(looked_at.where(~F.col("_window")), F.lit(least)))
    left = looked_at.where("_window").join(found.select("_file"), "_file", "left_anti")
    short = F.col("_line") % (max(lengths) + 1) < SHORT_WINDOW
    return found.unionByName(best_of(left, F.when(short, F.lit(max(least_window, LEAST_SHORT))).otherwise(F.lit(least_window))))


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``files`` (path, text) with license, origin (own or inherited), licensed_by (the directory) and score."""
    results = ("license", "origin", "licensed_by", "score")
    kept = [c for c in files.columns if c not in results and not c.startswith("_")]
    base = files.select(*kept, F.xxhash64(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("_file"),
                        F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"(?s)\A(.*)/[^/]*\z", 1)).alias("_dir"),
                        F.rlike(F.regexp_extract("path", r"(?s)([^/]*)\z", 1), F.lit(LICENCE_FILE)).alias("_grants"))
    found = cut_lineage(notices(base.select("_file", "text"), templates, least))
    small = base.drop("text") if "text" in kept else base
    own = cut_lineage(small.join(found, "_file", "left"))
    grants = own.where(F.col("_grants") & F.col("license").isNotNull() & F.col("_dir").isNotNull()).groupBy("_dir").agg(
        F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("license").alias("license"), F.col("score").alias("score"))).alias("_best"))
    grants = cut_lineage(grants.select(F.col("_dir").alias("_above"), F.col("_best.license").alias("_license"), F.col("_best.score").alias("_score")))
    folders = own.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = folders.select("_dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(
        F.slice(parts, F.lit(1), k), "/"))).alias("_depth", "_above"))
    nearest = cut_lineage(above.join(grants, "_above").groupBy("_dir").agg(
        F.max(F.struct("_depth", "_above", "_license", "_score")).alias("_from")))
    out = own.join(nearest, "_dir", "left")
    mine = F.col("license").isNotNull()
    columns = {"origin": F.when(mine, "own").when(F.col("_from").isNotNull(), "inherited"),
               "licensed_by": F.when(~mine, F.when(F.col("_from._above") == "", "/").otherwise(F.col("_from._above"))),
               "license": F.coalesce("license", "_from._license"), "score": F.coalesce("score", "_from._score")}
    return out.select(*[c for c in kept if c != "text"], *[c.alias(n) for n, c in columns.items()])
