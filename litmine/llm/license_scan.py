"""Operator 8: license scans with MinHash bands over text windows, in DataFrame functions only.

Texts and templates are lower-cased words of letters, digits and dots; shingles are five words (all words of a shorter
template, for whose sake texts have shingles of that size too). For every length that a template has, a text has overlapping windows of that many shingles, an eighth of the
length apart. A window with at least one shingle of a template of its length is hashed into bands; other windows hold no
shingle of it, so they cannot match and are not made. Equal bands retrieve templates, and a retrieved template matches if
at least 0.8 of its shingles stand in the window or one step beside it.

A template copied without change starts at most half a step from a window, so the two sets have a Jaccard similarity J of
at least 0.88, and with ``BANDS`` = 24 bands of ``ROWS`` = 2 hashes one band is equal with probability 1 - (1 - J^2)^24,
over 1 - 10^-15; at the least containment of 0.8, where J is about 0.6, it is over 0.9999.

Nulls and edges: a null text has no words; rows are told apart by id and digest of the text, so that rows with a null or
shared id are scanned like any other and repeated rows give one result; a license may have several templates; other columns
are ignored; templates without words never match; an empty table, or one without templates, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
ROWS = 2

# License notices by name.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0 header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    (
        "BSD redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0 header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def notices(spark: SparkSession) -> DataFrame:
    """``(license, text)`` of the built-in notices; any table of this form can take its place."""
    return spark.createDataFrame(list(NOTICES), "license string, text string")


def words(text: str) -> Column:
    """Lower-case words; dots at their ends are not part of them."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " ")
    return F.split(F.trim(plain), " +")


def once(value: Column) -> Column:
    """``value`` as the only row of a generator. The optimiser does not copy an expression through a generator, so an array
    that later functions look into many times is made once per row."""
    return F.explode(F.array(value))


def shingles(of: str, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of an array of words, by place; none if there are fewer words than ``size``."""
    w = F.col(of)
    place = F.sequence(F.lit(1), F.size(w) - (size - 1))
    whole = F.transform(place, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, whole).otherwise(F.array().cast("array<bigint>"))


def shingles_by_size(of: str, sizes: Iterable[int]) -> Column:
    """One struct ``(size, h)`` of ``shingles`` for each of ``sizes``."""
    return F.array(*[F.struct(F.lit(k).alias("size"), shingles(of, k).alias("h")) for k in sizes])


def bands(window: str) -> Column:
    """Band keys of a set of shingle hashes: every band is a hash of its number and of ``ROWS`` least hashes."""
    least = lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[
        F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)
    ])


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, license, begin, containment)``: for every document and license found in it the best match, the first of
    equal ones; ``begin`` is the word, from 0, at which its window begins. ``templates`` is a short list of notices."""
    known = templates.filter(F.col("text").isNotNull()).select("license", words("text").alias("w")).filter("w[0] <> ''")
    sized = F.filter(shingles_by_size("w", range(1, SHINGLE + 1)), lambda x: x["size"] == F.least(F.size("w"), F.lit(SHINGLE)))
    known = known.select("license", F.md5(F.array_join("w", " ")).alias("template"), once(sized[0]).alias("s"))
    known = known.select("license", "template", "s.size", F.array_distinct("s.h").alias("shingles"), F.size("s.h").alias("length"))
    listed = known.collect()  # the notices, a list of the caller
    if not listed:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("begin"), F.lit(0.0).alias("containment")).limit(0)
    lengths_of: dict[int, set[tuple[int, int]]] = {}
    for t in listed:
        for h in t["shingles"]:
            lengths_of.setdefault(h, set()).add((t["size"], t["length"]))
    marks = docs.sparkSession.createDataFrame(
        [(h, *n) for h, lengths in lengths_of.items() for n in sorted(lengths)], "hash long, size int, length int"
    )
    step = F.greatest(F.lit(1), F.floor(F.col("length") / 8).cast("int"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.md5(text).alias("of"), once(words("text")).alias("w"))
    sizes = sorted({t["size"] for t in listed})
    hashed = texts.select("doc_id", "of", F.explode(shingles_by_size("w", sizes)).alias("s")).select("doc_id", "of", "s.size", "s.h")
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.get("h", i).isin(*lengths_of))
    hits = hashed.filter(F.size("h") > 0).select("doc_id", "of", "size", "h", once(places).alias("places"))
    hit = hits.filter(F.size("places") > 0).select("doc_id", "of", "size", "h", F.explode("places").alias("place"))
    # as many rows as the notices have shingles
    hit = hit.withColumn("hash", F.get("h", "place")).join(F.broadcast(marks), ["hash", "size"])
    first = F.greatest(F.lit(0), F.ceil((F.col("place") - F.col("length") + 1) / step).cast("int"))
    starts = F.transform(F.sequence(first, F.floor(F.col("place") / step).cast("int")), lambda k: k * step)
    own = ["doc_id", "of", "size", "length"]
    begun = hit.select(*own, "h", step.alias("step"), F.explode(starts).alias("begin"))
    around = F.slice("h", F.greatest(F.lit(0), F.col("begin") - F.col("step")) + 1, F.col("length") + 2 * F.col("step"))
    window = F.slice("h", F.col("begin") + 1, F.col("length"))
    windows = begun.select(*own, "begin", window.alias("window"), around.alias("around"))
    windows = windows.dropDuplicates([*own, "begin"])  # one text, one place: the window is the same
    banded = windows.select(*own, "begin", "around", F.explode(bands("window")).alias("band"))
    bands_of = known.select("license", "template", "size", "length", "shingles", F.explode(bands("shingles")).alias("band"))
    met = banded.join(F.broadcast(bands_of), ["size", "length", "band"])
    met = met.dropDuplicates(["doc_id", "of", "license", "template", "begin"])
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    found = met.select("doc_id", "of", "license", "begin", share.alias("containment")).filter(F.col("containment") >= containment)
    best = F.min(F.struct((-F.col("containment")).alias("less"), "begin")).alias("best")
    return found.groupBy("doc_id", "of", "license").agg(best).select(
        "doc_id", "license", F.col("best.begin").alias("begin"), (-F.col("best.less")).alias("containment")
    )
