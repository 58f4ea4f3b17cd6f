"""Pooled blocks against plain pooling and the built-in fit."""

import random

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from riskweave.operators import isotonic, models

SCHEMA = "g string, s double, y int, low int"


def plain(points):
    """max-min formula over distinct scores: fitted value of each score."""
    sums = {}
    for s, y in points:
        a, n = sums.get(s, (0, 0))
        sums[s] = (a + y, n + 1)
    xs = sorted(sums)
    mean = lambda i, j: sum(sums[x][0] for x in xs[i : j + 1]) / sum(sums[x][1] for x in xs[i : j + 1])
    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


def test_groups_equal_the_formula(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 2], round(rng.random() * 2, 1), int(rng.random() < 0.4), 1) for i in range(300)]
    rows += [("hot", 0.5, i % 2, 1) for i in range(500)] + [(None, 0.1 * i, 1 - i % 2, 1) for i in range(6)]
    rows += [("a", None, 1, 1), ("b", float("nan"), 0, 1), ("a", 0.3, None, 1), ("one", 0.7, 1, 1)]
    got = isotonic.isotonic_blocks(spark.createDataFrame(rows, SCHEMA).repartition(3), "s", "y", ["g"]).collect()
    for g in {r[0] for r in rows}:
        points = [(s, y) for h, s, y, _ in rows if h == g and s is not None and s == s and y is not None]
        blocks = [b for b in got if b.g == g]
        for s, value in plain(points).items():
            holding = [b for b in blocks if b.low <= s <= b.high]
            assert len(holding) == 1 and holding[0].fitted == pytest.approx(value, abs=1e-12)
        assert sum(b.n for b in blocks) == len(points)


def test_many_ranges_merge(spark, monkeypatch):
    monkeypatch.setattr(isotonic, "MERGED", 2)
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges are not put together
    try:
        rng = random.Random(9)
        rows = [("x", float(i % 97), int(rng.random() < (i % 97) / 120), 0) for i in range(3000)]
        rows += [("down", float(i), int(i < 40), 0) for i in range(80)]
        got = isotonic.isotonic_blocks(spark.createDataFrame(rows, SCHEMA), "s", "y", ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    want = plain([(s, y) for g, s, y, _ in rows if g == "x"])
    blocks = sorted((b for b in got if b.g == "x"), key=lambda b: b.low)
    assert all(a.fitted < b.fitted and a.high < b.low for a, b in zip(blocks, blocks[1:]))
    for s, value in want.items():
        assert next(b.fitted for b in blocks if b.low <= s <= b.high) == pytest.approx(value, abs=1e-12)
    assert [(b.low, b.high, b.fitted, b.n) for b in got if b.g == "down"] == [(0.0, 79.0, 0.5, 80)]


def test_model_equals_the_built_in_fit(spark):
    rng = random.Random(3)
    rows = [("x", round(rng.random(), 2), int(rng.random() < 0.5), 0) for _ in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = df.groupBy("s", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    whole = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w", predictionCol="p").fit(pairs.withColumn("y", F.col("y").cast("double")))
    asked = spark.createDataFrame([(i / 173,) for i in range(-20, 200)], "s double")
    want = {r.s: r.p for r in whole.transform(asked).collect()}
    got = {r.s: r.c for r in models.apply_isotonic(asked, models.fit_isotonic(df, "s", "y"), "s", "c").collect()}
    assert all(got[s] == pytest.approx(p, abs=1e-12) for s, p in want.items())


def test_empty(spark):
    assert isotonic.isotonic_blocks(spark.createDataFrame([], SCHEMA), "s", "y", ["g"]).count() == 0
