"""License scan, in column expressions only.

A text is read in overlapping windows of ``WINDOW`` shingles.  The MinHash of a
window under each of ``BANDS`` hash functions is one band; a template whose own
windows have a band in common is retrieved and then verified by exact shingle
containment.

With one row per band, a window of similarity s to one of the template's is
missed with probability (1 - s) ** BANDS.  A notice of three shingles, the
shortest allowed, that lies within a window of six has s >= 1/2; it is missed
with probability 2 ** -16 at most.  A longer notice fills at least one window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.functions.arrays import bind
from newsflow.llm.common import small_side, stage

WIDTH = 3  # words of a shingle: short notices have five words
WINDOW = 6  # shingles of a window
STEP = 2  # shingles from one window to the next
BANDS = 16
CONTAINMENT = 0.8
# Shingles of all notices together.  A shingle begins at most one window, so the
# template table has at most 1 + BANDS longs for each: under 9 MB.
MOST = 1 << 16

# The usual wording of notices.  Those of a family (GPL, CC) are cut
# to the words that tell them apart, so that one is not contained in another.
NOTICES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
                      " and associated documentation files (the \"Software\"), to deal in the Software without"
                      " restriction",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted"
                      " provided that the following conditions are met",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of"
                         " the License at",
    "MIT-licensed": "Licensed under the MIT License.",
    "GPL-header": "terms of the GNU General Public License as published",
    "LGPL-header": "terms of the GNU Lesser General Public License as published",
    "LGPL-2.0-header": "terms of the GNU Library General Public License as published",
    "AGPL-header": "terms of the GNU Affero General Public License as published",
    "GPL-2.0-short": "GNU General Public License, version 2",
    "GPL-3.0-short": "GNU General Public License, version 3",
    "GPL-2.0-v": "GNU General Public License v2.0",
    "GPL-3.0-v": "GNU General Public License v3.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL": "made available under the terms of the Eclipse Public License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
           " hereby granted",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors"
            " be held liable for any damages arising from the use of this software",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0-long": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 Unported",
    "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "CC0-1.0": "CC0 1.0 Universal Public Domain Dedication",
    "CC0-waiver": "has waived all copyright and related or neighboring rights to this work",
}


def plain_words(text: Column) -> Column:
    """ASCII letters and digits in runs, lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def shingle_hashes(words: Column) -> Column:
    """One hash per ``WIDTH`` words, in text order; none for shorter texts."""

    def of(w: Column) -> Column:
        return F.when(
            F.size(w) >= WIDTH,
            F.transform(F.sequence(F.lit(1), F.size(w) - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(w, i, WIDTH))),
        ).otherwise(F.array().cast("array<bigint>"))

    return bind(words, of)


def band_keys(hashes: Column, step: int) -> Column:
    """Distinct band values of all windows; the last window ends with the text.
    A text shorter than a window is one window."""

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - (WINDOW - 1), F.lit(1))
        starts = F.array_union(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))

        def keys(band: Column) -> Column:
            # seed and shingle hashed again: another order of the shingles for each band
            def in_band(again: Column) -> Column:
                return F.transform(starts, lambda i: F.xxhash64(band, F.array_min(F.slice(again, i, WINDOW))))

            return bind(F.transform(h, lambda x: F.xxhash64(band, x)), in_band)

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(BANDS)), keys)))

    return F.when(F.size(hashes) > 0, bind(hashes, of)).otherwise(F.array().cast("array<bigint>"))


def _templates(spark: SparkSession, notices: Mapping[str, str]) -> DataFrame:
    """Shingles and band keys of each notice: a staged table of bounded size."""
    if not notices:
        raise ValueError("no notices to look for")
    rows = spark.createDataFrame(list(notices.items()), "license string, text string")
    hashes = shingle_hashes(plain_words(F.col("text")))
    table = stage(rows.select(
        "license", F.array_distinct(hashes).alias("shingles"), band_keys(hashes, 1).alias("template_keys")), "templates")
    sizes = table.select("license", F.size("shingles").alias("n")).collect()
    short = [r["license"] for r in sizes if r["n"] < 3]
    if short:
        raise ValueError(f"notices need three different shingles: {short}")
    if sum(r["n"] for r in sizes) > MOST:
        raise ValueError(f"notices have more than {MOST} shingles")
    return table


def _longs(values) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<bigint>")


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    notices: Mapping[str, str] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, license, n_shingles, n_found, containment) of all documents and
    the notices they contain: at least ``containment`` of a notice's distinct
    shingles occur in the whole text.

    Texts with fewer shingles of any notices than the shortest one needs, nearly
    all, are left out before any window is hashed; they cannot reach the
    containment.  The others meet the table of templates, which is small enough
    to be broadcast, where they have a band key in common.  A null or short text
    contains nothing.  Every input row counts, repeated ones too.
    """
    templates = _templates(docs.sparkSession, notices)
    stored = templates.select("shingles", "template_keys").collect()
    known = _longs(sorted({s for t in stored for s in t["shingles"]}))
    keys = _longs(sorted({k for t in stored for k in t["template_keys"]}))
    least = min(max(1, math.ceil(containment * len(t["shingles"]) - 1e-9)) for t in stored)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), shingle_hashes(plain_words(text)).alias("h"))
    rows = rows.where(bind(F.col("h"), lambda h: F.when(
        F.arrays_overlap(h, known), F.size(F.array_intersect(h, known)) >= least).otherwise(False)))
    rows = rows.withColumn("keys", F.array_intersect(band_keys(F.col("h"), STEP), keys))
    found = rows.join(small_side(templates), F.arrays_overlap("keys", "template_keys"))
    n_found = F.size(F.array_intersect("h", "shingles")).cast("bigint")
    out = found.select(
        "doc_id", "license", F.size("shingles").cast("bigint").alias("n_shingles"), n_found.alias("n_found"))
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(
        F.col("containment") >= containment)
