"""License notices by MinHash bands over overlapping windows, verified by exact containment.

Every text is cut into overlapping windows of words. A window and a template that share
a band of MinHash values are a candidate; it is a match if the window has at least the
given share of the template's word shingles. All of it is built-in column expressions.

Two exact skips come first, as a window without any template shingle cannot match: texts
without any of a few words that every template shingle has one of, and windows without a
template shingle. Bands have one row, so a template of one shingle in a full window (the
worst case, a similarity of 1 / 20) meets its window with a chance of 99.8 %, and every
notice lies in two or three windows.

Defined results: one row per document and license found, none for a null or empty text
or an empty table; rows with the same id are one document; further columns are never
read. Words are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW, STRIDE = 24, 8
BANDS = 128
LEAST = 0.8
#: Longest notice that always lies in one window.
MOST_WORDS = WINDOW - STRIDE + 1

# Usual wording of public license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def telling_words(templates: list[tuple[str, str]], least: float = LEAST) -> list[str]:
    """A few long words, of which every match has at least one.

    A match lacks fewer than ``missing`` shingles of its template, so it has a word of the list
    if ``missing`` shingles of each template have one.
    """
    grams = [[set(w[i:i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)] for w in (_words(t) for _, t in templates)]
    missing = [len(g) - math.ceil(least * len(g) - 1e-9) + 1 for g in grams]
    out: list[str] = []

    def hit(g: list[set[str]], words: list[str]) -> int:
        return sum(bool(s.intersection(words)) for s in g)

    while any(hit(g, out) < n for g, n in zip(grams, missing)):
        words = sorted({w for g, n in zip(grams, missing) if hit(g, out) < n for s in g for w in s} - set(out))
        out.append(max(words, key=lambda w: (
            sum(min(n, hit(g, [*out, w])) - min(n, hit(g, out)) for g, n in zip(grams, missing)) * (len(w) > 6), len(w), w)))
    return out


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of all word shingles, in order. ``words`` must be a column of its own, as every shingle refers to it."""
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, SHINGLE)))))


def bands(values: Column) -> Column:
    """Least value under each of the hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(values, lambda x: F.xxhash64(x, b))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None,
         least: float = LEAST) -> DataFrame:
    """``doc_id``, ``license``, best ``containment``, ``first_word`` of the first window, ``n_windows``."""
    templates = TEMPLATES if templates is None else templates
    if not all(SHINGLE <= len(_words(t)) <= MOST_WORDS for _, t in templates):
        raise ValueError(f"a template has {SHINGLE} to {MOST_WORDS} words")
    spark = docs.sparkSession
    known = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.array(*map(F.lit, _words(t))).alias("words")) for i, (name, t) in enumerate(templates)
    ])).alias("t")).select("t.template", "t.license", F.array_distinct(shingles(F.col("t.words"))).alias("own"))
    # a fixed number of rows: templates times bands
    met = F.broadcast(known.select("template", "license", "own", F.posexplode(bands(F.col("own"))).alias("band", "value")))
    # their hashes as plain values, a number fixed by the templates: as an expression they would be made anew for every window
    every = sorted({h for r in known.select("own").collect() for h in r.own})

    low = F.lower(text)
    telling = telling_words(templates, least)
    some = low.contains(telling[0])
    for word in telling[1:]:
        some = some | low.contains(word)
    rows = docs.where(some).select(F.col(doc_id).alias("doc_id"), split_words(F.col(text)).alias("words"))
    # no filter on the shingles: it would be moved below them, to where every shingle splits the whole text anew
    rows = rows.select("doc_id", shingles(F.col("words")).alias("all"))
    size = WINDOW - SHINGLE + 1
    # a text of fewer words than a shingle has none
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(STRIDE)))
    cut = F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("all", s + 1, size).alias("have")))
    cut = F.filter(cut, lambda w: F.exists(w["have"], lambda h: h.isin(every)))
    windows = rows.select("doc_id", F.explode(cut).alias("w")).select("doc_id", "w.*")
    seen = windows.select("doc_id", "first", "have", F.posexplode(bands(F.col("have"))).alias("band", "value"))
    share = F.size(F.array_intersect("own", "have")) / F.size("own")
    found = seen.join(met, ["band", "value"]).where(share >= least)
    return found.select("doc_id", "license", "first", share.alias("share")).groupBy("doc_id", "license").agg(
        F.max("share").alias("containment"), F.min("first").cast("long").alias("first_word"),
        F.count_distinct("first").alias("n_windows"))
