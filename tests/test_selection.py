"""Medians by digits, clustering restarts and pattern tables against plain versions."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import attribution as at, clusters as cl, encode, fitted
from riskweave.session import materialise


def test_images_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-320, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf, np.nan])
    image = encode.ordered_image(x)
    assert (np.diff(image) >= 0).all() and image[4] == image[5] and (np.diff(image) > 0).sum() == 10
    assert all(encode.of_image(int(i)) == v or v != v for i, v in zip(image, x))


@pytest.mark.parametrize("digit", [3, 12])
def test_medians_equal_a_plain_sort(spark, monkeypatch, digit):
    monkeypatch.setattr(encode, "DIGIT", digit)
    rng = np.random.default_rng(1)
    n = 801
    columns = {
        "real": rng.normal(size=n), "close": 1 + rng.integers(0, 5, n) * 2.0**-50, "flag": rng.integers(0, 2, n).astype(float), "tiny": rng.normal(size=n) * 1e-310,
        "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)), "signed": np.where(np.arange(n) % 2, -3.0, 3.0), "same": np.full(n, -2.0),
    }
    rows = [tuple(None if (i + j) % 9 == 0 and c != "signed" else float(columns[c][i]) for j, c in enumerate(columns)) + (None,) for i in range(n - 1)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", nothing double").repartition(4)
    got = {r["column"]: r["median"] for r in encode.column_medians(df, [*columns, "nothing"]).collect()}
    want = {c: float(np.median([r[j] for r in rows if r[j] is not None])) for j, c in enumerate(columns)}
    assert got == want
    assert encode.column_medians(df.limit(0), ["real"]).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(4, 6)) * 3
    x = [(middles[i % 4] + rng.normal(size=6)).tolist() for i in range(900)] + [[9.0] * 6] * 300
    return materialise(spark.createDataFrame([(v,) for v in x], "x array<double>").repartition(3), "points")


def test_restarts_are_no_worse_than_serial_ones(spark, points):
    found = cl.fit_centres(points, 4, 10)
    vectors = points.select(array_to_vector("x").alias("v")).cache()
    serial = min(KMeans(k=4, maxIter=300, seed=42 + i, featuresCol="v").fit(vectors).summary.trainingCost for i in range(10))
    assert found.cost <= serial * 1.001 and found.sizes.sum() == 1200
    x = np.array([r.x for r in points.collect()])
    assert found.cost == pytest.approx(cl.squared(x, found.centres).min(axis=1).sum())
    again = cl.fit_centres(points.repartition(7), 4, 10)
    assert again.cost == pytest.approx(found.cost)
    placed = fitted.FittedCentres.of(found.centres, "x", "c").transform(points)
    assert {r.c: r["count"] for r in placed.groupBy("c").count().collect()} == {i: int(n) for i, n in enumerate(found.sizes) if n}


def test_iterations_scan_once_for_all_restarts(points, monkeypatch):
    scans = []
    keep = cl._sums
    monkeypatch.setattr(cl, "_sums", lambda *a: scans.append(1) or keep(*a))
    found = cl.fit_centres(points, 4, 10)
    # Three rounds of seeding, the weights of the seeds, the spread, and a scan per iteration.
    assert len(scans) == found.scans + cl.SEED_ROUNDS + 2


def test_fewer_rows_than_centres(spark):
    few = materialise(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([3.0, 4.0],)], "x array<double>"), "few")
    found = cl.fit_centres(few, 4, 3)
    assert found.cost == pytest.approx(0) and found.sizes.sum() == 3 and found.centres.shape == (4, 2)


def plain_values(shares, known):
    """By all coalitions."""
    m = len(shares)
    pays = lambda s: float(np.prod([known[i] if i in s else shares[i] for i in range(m)]))
    out = []
    for i in range(m):
        others = [j for j in range(m) if j != i]
        out.append(sum(
            factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (pays({*s, i}) - pays(set(s)))
            for n in range(m) for s in itertools.combinations(others, n)
        ))
    return out


@pytest.mark.parametrize("shares", [[0.5], [0.25, 0.9], [0.1, 0.5, 1.0], [0.3, 0.0, 0.6, 0.2], [0.001, 0.999, 0.5, 0.4, 0.7, 0.2]])
def test_pattern_tables_equal_all_coalitions(shares):
    table = at.pattern_table(shares)
    m = len(shares)
    for pattern in range(1 << m):
        known = [(pattern >> i) & 1 for i in range(m)]
        assert table[pattern] == pytest.approx(plain_values(shares, known), abs=1e-9)
        assert table[pattern].sum() == pytest.approx(np.prod(known) - np.prod(shares), abs=1e-9)


def test_tables_beyond_the_bound_change_nothing(monkeypatch):
    paths = [(0.5, {0: [0.4, -np.inf, 1.0], 2: [0.5, 0.0, np.inf]}), (2.0, {1: [0.3, -1.0, 2.0]}), (1.0, {})]
    x = np.random.default_rng(0).normal(size=(50, 3)) * 2
    want = at.Leaves(paths).attribute(x)
    monkeypatch.setattr(at, "TABLE_BYTES", 0)
    few = at.Leaves(paths)
    assert np.array_equal(few.attribute(x), want) and not few._tables
    assert few.expected == pytest.approx(0.5 * 0.2 + 0.6 + 1)
