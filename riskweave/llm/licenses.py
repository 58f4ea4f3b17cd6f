"""License scans by MinHash bands over overlapping text windows, by DataFrame functions alone.

Texts and templates become sets of five-word shingles. For templates of up to ``S`` shingles
(``S`` a power of two, at least their count and less than twice that) a text is cut into windows of ``2 S`` shingles,
each starting ``S`` after the one before, so every run of ``S`` shingles lies in one window.
A window that holds ``CONTAINMENT`` of a template shares at least
``0.8 t / (2 S + 0.2 t)`` of the joint set with it, more than 0.19; with ``BANDS`` bands of one
MinHash each the two meet in some band with a probability above 1 - 0.81^64 = 0.999998. Pairs that meet are verified:
the share of the template's shingles, as text, that the window holds.

A band of a window can equal a template's only through a shingle they share, so signatures
are made for windows that hold at least one template shingle, and only for those.

Nothing is shuffled but the matches. Templates are sent to all tasks, behind a bound on their
number of shingles (``MAX_TEMPLATE_SHINGLES``).

Cases: null, empty and short texts (fewer than five words) match nothing. A text is scanned
whole at any length. Repeated rows and null ids are matched row by row; equal templates match alike. A text
that holds a template several times is one row with the number of windows. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import table

WORDS = 5
CONTAINMENT = 0.8
BANDS = 64
MAX_TEMPLATE_SHINGLES = 20_000

#: Public notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction'
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; letters beyond ASCII count whole."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def _shingles(words: Column, shingle) -> Column:
    """``shingle(start)`` for every run of WORDS words; starts count from 1."""
    starts = F.sequence(F.lit(1), F.size(words) - (WORDS - 1))
    return F.when(F.size(words) >= WORDS, F.transform(starts, shingle))


def hashes_of(words: Column) -> Column:
    return _shingles(words, lambda i: F.xxhash64(F.slice(words, i, WORDS)))


def texts_of(words: Column) -> Column:
    return _shingles(words, lambda i: F.array_join(F.slice(words, i, WORDS), " "))


def signature(hashes: Column) -> Column:
    """One MinHash for each band."""

    def smallest(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*map(smallest, range(BANDS)))



def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, shingles (texts), bands, S, of every template of at least five words."""
    raw = spark.createDataFrame(sorted(templates.items()), "template string, text string").withColumn("words", words_of(F.col("text")))
    hashed = raw.withColumn("hashes", F.array_distinct(hashes_of(F.col("words")))).filter("hashes is not null")
    n = F.size("hashes")
    stride = F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("int")
    return hashed.select("template", "hashes", F.array_distinct(texts_of(F.col("words"))).alias("shingles"), signature(F.col("hashes")).alias("bands"), stride.alias("stride"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and matched template: best containment, windows, first word."""
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    rows = known.select("hashes", "stride").collect()  # as many as templates were given
    wanted = sorted({h for r in rows for h in r.hashes})
    if len(wanted) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"templates have {len(wanted)} shingles; scan with at most {MAX_TEMPLATE_SHINGLES} at a time")
    strides = sorted({r.stride for r in rows}) or [1]

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    hashed = texts.withColumn("hashes", hashes_of(F.col("words")))
    # Places (from 0) of shingles that some template has; most texts have none and end here.
    shared = F.transform(F.col("hashes"), lambda h, i: F.when(h.isin(wanted), i))
    placed = hashed.withColumn("places", F.filter(shared, lambda i: i.isNotNull())).filter(F.size("places") > 0)

    def starts(stride: int) -> Column:
        last = F.greatest(F.ceil(F.size("hashes") / stride).cast("int") - 2, F.lit(0))
        block = lambda i: F.floor(i / stride).cast("int")
        both = F.flatten(F.transform("places", lambda i: F.array(F.least(block(i), last), F.least(F.greatest(block(i) - 1, F.lit(0)), last))))
        return F.transform(F.array_distinct(both), lambda w: F.struct(F.lit(stride).alias("stride"), (w * stride).alias("at")))

    windows = placed.withColumn("w", F.explode(F.concat(*map(starts, strides)))).select(
        "row", "doc_id", F.col("w.stride").alias("stride"), F.col("w.at").alias("at"),
        F.slice("hashes", F.col("w.at") + 1, 2 * F.col("w.stride")).alias("in_window"),
        F.slice("words", F.col("w.at") + 1, 2 * F.col("w.stride") + WORDS - 1).alias("window_words"),
    )
    banded = windows.select("row", "doc_id", "stride", "at", "window_words", F.posexplode(signature(F.col("in_window"))).alias("band", "value"))
    template_bands = known.select("template", "shingles", "stride", F.posexplode("bands").alias("band", "value"))
    # At most MAX_TEMPLATE_SHINGLES shingles, and BANDS rows a template.
    met = banded.join(F.broadcast(template_bands), ["stride", "band", "value"])
    held = F.size(F.array_intersect(F.col("shingles"), texts_of(F.col("window_words")))) / F.size("shingles")
    # A window meets a template in several bands and is verified at each: there are few.
    verified = met.select("row", "doc_id", "template", "at", held.alias("containment")).filter(F.col("containment") >= containment)
    per_doc = verified.groupBy("row", "doc_id", "template").agg(
        F.max("containment").alias("containment"), F.count_distinct("at").alias("n_windows"), F.min("at").cast("long").alias("first_word")
    )
    return per_doc.drop("row")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1_sql() -> str:
    """Windows and containment of all templates, without signatures."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""
WITH notices(template, text) AS (VALUES {values}),
template_words AS (SELECT template, {words} AS w FROM notices),
template_shingles AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT template, w, unnest(range(1, len(w) - 3)) AS i FROM template_words WHERE len(w) >= 5)
),
sizes AS (SELECT template, count(*) AS t, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS stride FROM template_shingles GROUP BY template),
doc_words AS (SELECT doc_id, {words} AS w FROM documents),
doc_shingles AS (
  SELECT doc_id, n, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, len(w) - 4 AS n, unnest(range(1, len(w) - 3)) AS i FROM doc_words WHERE len(w) >= 5)
),
met AS (
  SELECT doc_id, template, t, stride, shingle, place, greatest(CAST(ceil(n / stride) AS BIGINT) - 2, 0) AS last_window
  FROM doc_shingles JOIN template_shingles USING (shingle) JOIN sizes USING (template)
),
placed AS (
  SELECT DISTINCT doc_id, template, t, stride, shingle, unnest([least(place // stride, last_window), least(greatest(place // stride - 1, 0), last_window)]) AS w
  FROM met
),
held AS (
  SELECT doc_id, template, w * stride AS window_start, count(DISTINCT shingle) / t AS containment
  FROM placed GROUP BY doc_id, template, t, stride, w
)
SELECT doc_id, template, max(containment) AS containment, count(DISTINCT window_start) AS n_windows, CAST(min(window_start) AS BIGINT) AS first_word
FROM held WHERE containment >= {CONTAINMENT} GROUP BY doc_id, template
"""
