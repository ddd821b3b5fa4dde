"""License notices found by MinHash bands over overlapping windows, then by exact containment; DataFrame functions only.

A text's words (as in decontamination) make shingles of five words. For each number m of shingles that a
template has, windows of m + m // 2 shingles begin every m // 2, so any run of m shingles lies in one whole window. A window's
signature has one MinHash value per band, the smallest of its shingles' keyed hashes; a window and a template meet
when any band agrees. A notice with containment c of m shingles shares c m of at most 1.5 m + (1 - c) m, so a band agrees with
probability c / (2.5 - c), 0.47 at 0.8, and all BANDS miss it with (1 - 0.47) ** 16 < 0.00004. Met windows are kept if
they contain at least ``containment`` of the template's distinct shingles, compared as words.

A window can only agree in a band if it holds the template's smallest shingle for it, so signatures are
computed in texts that hold one of those, which drops no window that would meet a template.

Templates of fewer than five words have no shingle and are never found; null ones neither. A null or short text has no window.
Repeated rows are reported each. Templates are a stated list: their number is checked against MAX_TEMPLATES before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified
from .decontaminate import words_of

SHINGLE = 5
BANDS = 16
MAX_TEMPLATES = 10_000

# Short notices as they stand in files.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _shingle_words(words: str) -> str:
    """SQL: the shingles of an array of words, space-joined."""
    n = f"size({words})"
    return f"if({n} >= {SHINGLE}, transform(sequence(1, {n} - {SHINGLE - 1}), i -> array_join(slice({words}, i, {SHINGLE}), ' ')), cast(array() as array<string>))"


def _shingle_hashes(words: str) -> str:
    n = f"size({words})"
    return f"if({n} >= {SHINGLE}, transform(sequence(1, {n} - {SHINGLE - 1}), i -> xxhash64(slice({words}, i, {SHINGLE}))), cast(array() as array<bigint>))"


def _bands(hashes: str, bands: int) -> str:
    """SQL: the smallest keyed hash of an array, per band."""
    return "array(" + ", ".join(f"array_min(transform({hashes}, x -> xxhash64(x, {j})))" for j in range(bands)) + ")"


def _literal(values: Iterable[int]) -> str:
    """SQL: an array of longs that is one constant of the plan."""
    text = ",".join(map(str, sorted(set(values))))
    return f"cast(split('{text}', ',') as array<bigint>)" if text else "cast(array() as array<bigint>)"


def templates_of(notices: DataFrame, id_column: str = "license", text_column: str = "text", bands: int = BANDS) -> DataFrame:
    """(license, m, shingles, bands: (band, value, smallest: the shingle behind it)) of templates with a shingle, one row per license and words."""
    words = notices.select(F.col(id_column).alias("license"), words_of(F.col(text_column).cast("string")).alias("w"))
    cut = f"explode(if(size(w) >= {SHINGLE}, transform(sequence(1, size(w) - {SHINGLE - 1}), i -> slice(w, i, {SHINGLE})), cast(array() as array<array<string>>)))"
    rows = words.selectExpr("license", "w", f"size(w) - {SHINGLE - 1} as m", f"{cut} as s").selectExpr("license", "w", "m", "array_join(s, ' ') as shingle", "xxhash64(s) as h")
    rows = rows.distinct().selectExpr("*", f"explode(sequence(0, {bands - 1})) as band").selectExpr("*", "struct(xxhash64(h, band) as value, h as smallest) as b")
    best = rows.groupBy("license", "w", "m", "band").agg(F.min("b").alias("b"), F.collect_set("shingle").alias("shingles"))
    return best.groupBy("license", "w", "m").agg(
        F.first("shingles").alias("shingles"), F.collect_list(F.struct("band", "b.value", "b.smallest")).alias("bands")
    ).drop("w")


def find_notices(
    docs: DataFrame, notices: DataFrame, id_column: str = "doc_id", text_column: str = "text", containment: float = 0.8, bands: int = BANDS,
) -> DataFrame:
    """(id, license, containment, first_word, n_windows): each row's notices, the best containment, where the first such window begins."""
    found = templates_of(notices, bands=bands).limit(MAX_TEMPLATES + 1).collect()
    if len(found) > MAX_TEMPLATES:
        raise ValueError(f"More than {MAX_TEMPLATES} license templates")
    spark = docs.sparkSession
    held = spark.createDataFrame(
        [(t.license, t.m, t.shingles, b.band, b.value) for t in found for b in t.bands],
        "license string, m int, shingles array<string>, band int, value long",
    )
    texts = identified(docs, id_column, text_column).select("_row", "_id", words_of(F.col("_text")).alias("_w"))
    texts = texts.withColumn("_h", F.expr(_shingle_hashes("_w")))
    windows = []
    for m in sorted({t.m for t in found}):
        step = max(1, m // 2)
        smallest = _literal(b.smallest for t in found if t.m == m for b in t.bands)
        cut = f"transform(sequence(0, greatest(0, size(_h) - 1), {step}), a -> struct(a as a, {m} as m, slice(_h, a + 1, {m + step}) as h))"
        windows.append(f"filter({cut}, x -> arrays_overlap(x.h, {smallest}))")
    none = "cast(array() as array<struct<a:int,m:int,h:array<bigint>>>)"
    # What a window needs of the text is cut out before the rows part. The test of the whole text stands inside the
    # expression: as a filter it would be moved below the hashes and make them anew for each shingle.
    width = "x.m + greatest(1, int(x.m / 2))"
    cut = f"transform(concat({', '.join([none, *windows])}), x -> struct(x.a as a, x.m as m, x.h as h, slice(_w, x.a + 1, {width} + {SHINGLE - 1}) as w))"
    holds = f"arrays_overlap(_h, {_literal(b.smallest for t in found for b in t.bands)})"
    empty = "cast(array() as array<struct<a:int,m:int,h:array<bigint>,w:array<string>>>)"
    rows = texts.selectExpr("_row", "_id", f"explode(if({holds}, {cut}, {empty})) as x")
    rows = rows.selectExpr("_row", "_id", "x.a", "x.m", "x.w", f"posexplode({_bands('x.h', bands)}) as (band, value)")
    met = rows.join(F.broadcast(held), ["m", "band", "value"])
    share: Column = F.size(F.array_intersect(F.expr(_shingle_words("w")), F.col("shingles"))) / F.size("shingles")
    met = met.withColumn("share", share).filter(F.col("share") >= containment)
    best = met.groupBy("_row", "_id", "license").agg(
        F.max("share").alias("containment"),
        F.min(F.struct((-F.col("share")).alias("s"), F.col("a").alias("a")))["a"].cast("long").alias("first_word"),
        F.count_distinct("a").alias("n_windows"),
    )
    return best.select("_id", "license", "containment", "first_word", "n_windows").toDF(id_column, "license", "containment", "first_word", "n_windows")
