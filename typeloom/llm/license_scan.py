"""License scan: banded MinHash over overlapping windows, then exact containment.

Plan: one pass over the documents, no shuffle, no join, no Python. A document's five-word
shingles are hashed once. Windows of 1, 2, 4 and 8 neighbouring shingles (``WIDTHS``) slide over
them, one for each place. A window's MinHash signature is cut into ``BANDS`` bands of ``ROWS``
minima; a band's value is a hash of its minima, and a value that some template's window has too
retrieves that template. A template's windows have the largest of the widths that it fills.

Collision: windows of Jaccard similarity s share a band with probability 1 - (1 - s ** ROWS) **
BANDS: 0.996 at s = 7/9, and 1 for equal windows. A document that has ``threshold`` of a
template's shingles mostly has a window's worth of them in a row (a replaced word spoils five
neighbouring shingles), so that some windows are equal. Where it hasn't, a match can be missed.
Retrieved templates are verified on the shingles' text: the share of the template's distinct
shingles that the document has must reach ``threshold``.

A minimum is the hash of one of the window's shingles, so a window without a shingle of any
template can't collide: windows are formed from a document's first such shingle to its last.

Two versions of a notice may share most of their shingles, so that a document reaches the
threshold for both. All that reach it are reported; ``outdone`` says that such a rival (a template
that has ``threshold`` of this one's shingles) matches more fully. ``fullest_only`` leaves the
outdone ones out.

The template table is bounded (``MAX_TEMPLATE_KEYS`` band values, checked): it is a
reference list of the caller's, not of the corpus, and goes into the plan as literals.

Defined cases: null or empty text, or fewer than five words: no match. A very long text is one
row like any other. Repeated rows each give their own rows. Rivals with the same share outdo
neither. An empty table gives no rows. A null ``doc_id`` stays null. Columns other than ``doc_id``
and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import BREAKS, bind, plain_words_of, whole_text

SHINGLE = 5
BANDS, ROWS = 6, 2
WIDTHS = (1, 2, 4, 8)
MAX_TEMPLATE_KEYS = 20_000

#: Short public notices by which texts state their license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


NO_HASHES = "array<bigint>"


def longs(values: Sequence[int]) -> Column:
    """An array literal, parsed at once."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})").cast(NO_HASHES)


def template_words(text: str) -> list[str]:
    """The same words that ``plain_words_of`` gives (used for templates, on the driver)."""
    return [w for w in re.split(BREAKS, text.lower()) if w]


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def width_of(shingles: int) -> int:
    return max(w for w in WIDTHS if w <= max(1, shingles))


def rivals_of(shingles: Sequence[Sequence[str]], threshold: float) -> list[list[int]]:
    """For each template, the others that have ``threshold`` of its distinct shingles."""
    sets = [set(ss) for ss in shingles]
    return [[j for j, other in enumerate(sets) if j != k and len(own & other) >= threshold * len(own) > 0] for k, own in enumerate(sets)]


def _none() -> Column:
    return F.array().cast(NO_HASHES)


def shingle_hashes(words: Column) -> Column:
    """A hash for each shingle of an array of words, made from the words' hashes."""
    count = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))

    def joined(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(SHINGLE)])
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(_none())

    return bind(F.transform(words, lambda w: F.xxhash64(w)), joined)


def window_minima(values: Column, width: int) -> Column:
    """Minima over each ``width`` (a power of two) neighbouring values; none if there are fewer."""
    if width == 1:
        return values

    def of_halves(half: Column) -> Column:
        last = F.size(half) - width // 2
        both = lambda i: F.least(F.get(half, i), F.get(half, i + width // 2))
        return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), both)).otherwise(_none())

    return bind(window_minima(values, width // 2), of_halves)


def band_values(shingles: Column, widths: Sequence[int]) -> Column:
    """The values of all bands of the MinHash signatures, a value for each band and window of these widths."""

    def permuted(band: Column, row: int) -> Column:
        return F.transform(shingles, lambda x: F.xxhash64(x, band * ROWS + row))

    def of_band(band: Column) -> Column:
        def of_width(width: int) -> Column:
            minima = F.arrays_zip(*[window_minima(permuted(band, r), width).alias(f"m{r}") for r in range(ROWS)])
            return F.transform(minima, lambda z: F.xxhash64(band, F.lit(width), *[z[f"m{r}"] for r in range(ROWS)]))

        return F.concat(*[of_width(width) for width in widths])

    return F.flatten(F.transform(F.array(*map(F.lit, range(BANDS))), of_band))


def template_keys(spark: SparkSession, shingles: Sequence[Sequence[str]]) -> tuple[list[list[int]], list[int]]:
    """Band values of each template, and the hashes of all their shingles, by the same expressions as in the scan."""
    rows = [(k, list(ss), width_of(len(ss))) for k, ss in enumerate(shingles) if ss]
    if not rows:
        return [[] for _ in shingles], []
    hashed = spark.createDataFrame(rows, "k int, s array<string>, w int").select("k", "w", F.transform("s", lambda x: bind(F.split(x, " "), shingle_hashes)[0]).alias("h"))
    values = F.when(F.lit(False), _none())
    for width in WIDTHS:
        values = values.when(F.col("w") == width, band_values(F.col("h"), [width]))
    keys: list[list[int]] = [[] for _ in shingles]
    single: set[int] = set()
    for r in hashed.select("k", "h", F.array_distinct(values).alias("v")).collect():  # the caller's templates only
        keys[r.k] = sorted(r.v)
        single |= set(r.h)
    return keys, sorted(single)


def retrieved(words: Column, known: Sequence[int], single: Sequence[int]) -> Column:
    """The band values of a document's windows that some template has too."""

    def of_windows(shingle: Column) -> Column:
        return F.array_intersect(band_values(shingle, WIDTHS), longs(known))

    def hits(shingle: Column) -> Column:
        places = F.filter(F.transform(shingle, lambda x, i: F.when(x.isin(*single), i + 1)), lambda i: i.isNotNull())
        return bind(places, lambda p: F.when(F.size(p) > 0, bind(around(shingle, p), of_windows)).otherwise(_none()))

    def around(shingle: Column, p: Column) -> Column:
        """The shingles from the first that a template has to the last, and a window's reach beyond them."""
        first = F.greatest(F.get(p, 0) - max(WIDTHS), F.lit(1))
        return F.slice(shingle, first, F.element_at(p, -1) + max(WIDTHS) - first + 1)

    return bind(shingle_hashes(words), hits)


def contained(words: Column, candidates: Column) -> Column:
    """Each candidate with the share of its distinct shingles that the document has."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    there = F.transform(places, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))

    def scored(s: Column) -> Column:
        share = lambda t: F.size(F.array_intersect(t["shingles"], s)) / F.size(t["shingles"])
        return F.transform(candidates, lambda t: F.struct(t["license"].alias("license"), t["no"].alias("no"), t["rivals"].alias("rivals"), share(t).alias("share")))

    return bind(there, scored)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, fullest_only: bool = False) -> DataFrame:
    """doc_id, license, template_no, containment, outdone: a row for each template that a document contains."""
    spark = docs.sparkSession
    shingles = [template_shingles(text) for _, text in templates]
    keys, single = template_keys(spark, shingles)
    known = sorted({k for ks in keys for k in ks})
    if len(known) > MAX_TEMPLATE_KEYS:
        raise ValueError(f"{len(known)} band values of templates; the plan takes {MAX_TEMPLATE_KEYS} at most")
    if not known:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, license string, template_no int, containment double, outdone boolean")

    def literal(k: int) -> Column:
        """A template: its number, name, band values, distinct shingles and rivals."""
        list_of = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
        return F.struct(
            F.lit(k).alias("no"),
            F.lit(templates[k][0]).alias("license"),
            longs(keys[k]).alias("keys"),
            list_of(sorted(set(shingles[k])), "string").alias("shingles"),
            list_of(rivals[k], "int").alias("rivals"),
        )

    rivals = rivals_of(shingles, threshold)
    table = F.array(*[literal(k) for k in range(len(templates)) if keys[k]])

    def matches(v: Column) -> Column:
        candidates = F.filter(table, lambda t: F.arrays_overlap(t["keys"], v["h"]))
        full = lambda scored: F.filter(scored, lambda m: m["share"] >= threshold)
        return bind(bind(contained(v["w"], candidates), full), ranked)

    def ranked(found: Column) -> Column:
        outdone = lambda m: F.exists(found, lambda o: F.array_contains(m["rivals"], o["no"]) & (o["share"] > m["share"]))
        return F.transform(found, lambda m: F.struct(m["license"].alias("license"), m["no"].alias("no"), m["share"].alias("share"), outdone(m).alias("outdone")))

    words = plain_words_of(F.col("t"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), whole_text(docs).alias("t"))
    hit = rows.select("doc_id", "t", bind(words, lambda w: retrieved(w, known, single)).alias("h")).where(F.size("h") > 0)
    found = hit.select("doc_id", F.explode(bind(F.struct(words.alias("w"), F.col("h").alias("h")), matches)).alias("m"))
    out = found.select("doc_id", F.col("m.license").alias("license"), F.col("m.no").alias("template_no"), F.col("m.share").alias("containment"), F.col("m.outdone").alias("outdone"))
    return out.where(~F.col("outdone")) if fullest_only else out
