"""Exact top-k search against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import mtree

SCHEMA = "vec_id long, embedding array<double>, region string, ask int, v int"
LONG = (1 << 63) - 1


def plain(rows, k=10, every=100):
    """rows: (id, vector or None); sorted (query, rank, id, score)."""
    kept = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * 1024) for x in v):
            kept.add((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for q, qv in kept:
        if math.fmod(q, every) == 0:
            scores = [(-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(qv, v)))), i) for i, v in kept if i != q]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10, every=100, **how):
    frame = spark.createDataFrame([(i, v, "r", 1, 2) for i, v in rows], SCHEMA).repartition(4)
    got = mtree.search(frame, F.col("vec_id") % every == 0, k=k, **how).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def cloud(n, size=12, seed=1, groups=9):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size))
    return [(int(i), (middles[i % groups] + 0.1 * rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"region": 40, "subtree": 15, "page": 4, "rounds": (1, 2, 3)}, {"region": 1, "subtree": 10_000, "page": 1000, "rounds": ()}])
def test_against_all_pairs(spark, how):
    rows = cloud(600)
    assert run(spark, rows, **how) == plain(rows)


def test_edges(spark):
    rng = random.Random(5)
    rows = cloud(220, size=3)
    rows += [(1000 + i, [0.5, 0.25, 0.125]) for i in range(80)]  # a crowd of copies
    rows += [(0, [0.5, 0.25, 0.125]), (0, [9.0, 9.0, 9.0]), (100, [0.5, 0.25, 0.125]), (100, [0.5, 0.25, 0.125])]
    rows += [(2000, None), (2100, []), (2200, [0.0, 0.0, 0.0]), (2300, [1.0]), (2400, [1.0, None, 1.0]), (2500, [1.0, float("nan"), 1.0])]
    rows += [(2600, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (2700, [-0.0, 0.0, -1e-9]), (-100, [-1.0, -2.0, -3.0])]
    rng.shuffle(rows)
    for how in ({}, {"region": 20, "subtree": 7, "page": 3}):
        assert run(spark, rows, **how) == plain(rows)


def test_fewer_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (100, [0.0, 1.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(0, None)]) == [] and run(spark, [(0, [1.0])]) == []


def test_components_past_double_and_long(spark):
    rows = cloud(60, size=3) + [(300, [3e9, 1e9, 5.0]), (301, [-3e9, 4e12, 1.0]), (400, [1e200, 0.0, 1.0]), (401, [1e300, 1e300, 1.0]), (402, [1e308, 0.0, 0.0])]
    assert run(spark, rows, region=10, subtree=10, page=2) == plain(rows)


def test_bounds_spare_products():
    """In clustered data most products are never computed, and the stored distances are what they say."""
    points = np.array([v for _, v in cloud(4000, groups=40)])
    x = np.floor(1024 * points)
    space = mtree.Space(12, float((x**2).sum(axis=1).max()))
    centre = space.lifted(x[:1])[0]
    pages = mtree.build(space, x, np.ones(len(x), np.int64), np.arange(len(x)), centre, 32)
    assert sorted(np.concatenate([p.ids for p in pages]).tolist()) == list(range(4000)) and max(len(p.x) for p in pages) <= 32
    for p in pages:
        assert np.allclose(mtree.gaps(space.lifted(p.x), p.centre), p.gap) and p.gap.max() == p.radius
        assert math.isclose(p.parent, float(mtree.gaps(p.centre[None, :], centre)[0]))
    spent = 0
    for q in range(0, 4000, 100):
        away = float(mtree.gaps(centre[None, :], np.append(x[q], 0.0))[0])
        scores, ids, computed = mtree.search_pages(space, pages, x[q], q, away, 10)
        true = x @ x[q]
        best = sorted((-int(s), i) for i, s in enumerate(true) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == best
        spent += computed
    assert spent < 40 * 4000 / 4
