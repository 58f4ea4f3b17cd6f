"""Histogram trees and Newton steps against plain searches, whatever the partitioning."""

import heapq

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import fitted, lockstep as L, newton
from riskweave.session import materialise


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 2, 700), rng.integers(0, 9, 700), rng.normal(size=700).round(2), rng.integers(0, 2, 700), np.ones(700)])
    y = (rng.random(700) < 1 / (1 + np.exp(-(2 * x[:, 0] + 0.5 * x[:, 1] - 3 + x[:, 0] * x[:, 2])))).astype(int)
    return x, y, np.arange(700) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, g = data
    frame = spark.createDataFrame([(i, int(y[i]), int(g[i]), x[i].tolist()) for i in range(len(y))], "id long, y int, g int, x array<double>")
    return materialise(frame.repartition(5).withColumn("features", array_to_vector("x")), "rows")


def fits():
    return [F.lit(True), F.col("g") != 0, F.col("g") == 1]


def packed(rows, parts=None):
    frame = rows if parts is None else rows.repartition(parts)
    counts = L.fit_counts(frame, "y", fits())
    bins = L.fit_bins(frame, "id")
    return L.pack(frame, "id", "y", fits(), bins, int(counts.sum()) if parts is None else 10**9), bins, counts


def same(a, b):
    for one, other in zip(a, b):
        assert len(one.trees) == len(other.trees)
        for s, t in zip(one.trees, other.trees):
            assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and np.array_equal(s.value, t.value) and np.array_equal(s.cover, t.cover)


def plain_boost(x, y, bins, rounds, step, leaves, depth, least):
    """Best leaf first by plain search over all rows of a leaf; all features in every round."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    raw = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = (p - y) * w, p * (1 - p) * w

        def best(rows, level):
            out = (0.0, None)
            if level == depth:
                return out
            whole = g[rows].sum() ** 2 / h[rows].sum()
            for f, edges in enumerate(bins.edges):
                for e in edges:
                    left = rows[x[rows, f] <= e]
                    right = rows[x[rows, f] > e]
                    if min(len(left), len(right)) >= least:
                        gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - whole
                        if gain > out[0] + 1e-7:
                            out = (gain, (f, e, left, right))
            return out

        ends, heap, tick = [], [], 0
        first = best(np.arange(len(y)), 0)
        heap.append((-first[0], tick, np.arange(len(y)), 0, first[1]))
        while heap:
            _, _, rows, level, split = heapq.heappop(heap)
            if split is None or len(heap) + len(ends) + 1 >= leaves:
                ends.append(rows)
                continue
            for part in split[2:]:
                tick += 1
                found = best(part, level + 1)
                heapq.heappush(heap, (-found[0], tick, part, level + 1, found[1]))
        for rows in ends:
            raw[rows] -= step * g[rows].sum() / h[rows].sum()
    return raw


@pytest.mark.parametrize("leaves", [4, 31])
def test_boosting_equals_a_plain_search(rows, data, leaves):
    x, y, g = data
    blocks, bins, counts = packed(rows)
    how = L.BoostSettings(rounds=3, step=0.3, leaves=leaves, depth=4, least_rows=12, columns=1.0)
    found = L.boost(blocks, bins, counts, np.zeros(3), [5] * 3, how)
    for mine, take in zip(found, (g >= 0, g != 0, g == 1)):
        model = fitted.FittedTrees.of(mine, bins, 5, mean=False)
        want = plain_boost(x[take], y[take], bins, 3, 0.3, leaves, 4, 12)
        assert np.allclose(model.scores(x[take]), want, atol=2e-4)
        assert all((t.feature >= 0).sum() < leaves for t in mine.trees)


def test_trees_do_not_depend_on_tasks_or_on_the_way_they_grow(rows):
    how = L.BoostSettings(rounds=6, depth=4, least_rows=10)
    forest = L.ForestSettings(trees=5, depth=4, least_rows=10)
    blocks, bins, counts = packed(rows)
    boosted = L.boost(blocks, bins, counts, np.zeros(3), [5, 5, 3], how)
    grown = L.grow_forests(blocks, bins, counts, forest)
    assert all((t.feature < 3).all() for t in boosted[2].trees)
    again, bins2, _ = packed(rows, 3)
    # No fit is whole, and a part of them is: one job per level, and both ways side by side.
    for whole in (0, int(counts[1].sum())):
        same(boosted, L.boost(again, bins2, counts, np.zeros(3), [5, 5, 3], how, whole_rows=whole))
        same(grown, L.grow_forests(again, bins2, counts, forest, whole_rows=whole))


def test_small_sums_split_the_jobs_not_the_trees(rows, monkeypatch):
    blocks, bins, counts = packed(rows)
    forest = L.ForestSettings(trees=4, depth=4, least_rows=10)
    grown = L.grow_forests(blocks, bins, counts, forest)
    monkeypatch.setattr(L, "SUMS", 500)
    same(grown, L.grow_forests(blocks, bins, counts, forest, whole_rows=0))


def test_forest_bags_and_leaves(rows, data):
    x, y, g = data
    blocks, bins, counts = packed(rows)
    forest = L.grow_forests(blocks, bins, counts, L.ForestSettings(trees=40, depth=5, least_rows=5))
    model = fitted.FittedTrees.of(forest[0], bins, 5, mean=True)
    p = model.scores(x)
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(len(p))
    auroc = (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auroc > 0.8 and 0 <= p.min() and p.max() <= 1
    # Balanced within each bag: the root of every tree is at one half.
    assert all(t.value[0, 1] == pytest.approx(0.5) for e in forest for t in e.trees)
    keys = np.arange(200_000, dtype=np.uint64)
    bag = L.bag_counts(L.mixed(keys), np.zeros(len(keys), np.int64), 3, 42)
    assert bag.mean() == pytest.approx(1, abs=0.01) and bag.var() == pytest.approx(1, abs=0.02) and (bag == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    other = L.bag_counts(L.mixed(keys), np.zeros(len(keys), np.int64), 4, 42)
    assert abs(np.corrcoef(bag, other)[0, 1]) < 0.01


def test_one_class_and_constant_features_make_leaves(spark):
    frame = materialise(spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(60)], "id long, y int, x array<double>").withColumn("features", array_to_vector("x")), "rows")
    bins = L.fit_bins(frame, "id")
    counts = L.fit_counts(frame, "y", [F.lit(True)])
    blocks = L.pack(frame, "id", "y", [F.lit(True)], bins, 60)
    for whole in (0, 100):
        found = L.boost(blocks, bins, counts, np.zeros(1), [2], L.BoostSettings(rounds=2), whole_rows=whole)
        assert all((t.feature == -1).all() for t in found[0].trees)
        assert all((t.feature == -1).all() for t in L.grow_forests(blocks, bins, counts, L.ForestSettings(trees=2), whole_rows=whole)[0].trees)


def test_edges():
    assert L.edges_of(np.array([1.0, 1.0])).tolist() == []
    assert L.edges_of(np.array([3.0, 1.0, 2.0, np.nan])).tolist() == [1.5, 2.5]
    many = L.edges_of(np.arange(10_000.0), 255)
    assert len(many) == 254 and np.histogram(np.arange(10_000), np.append(np.insert(many, 0, -1), 1e9))[0].max() <= 80
    hot = L.edges_of(np.append(np.zeros(5000), np.arange(1.0, 5001)), 10)
    assert len(hot) >= 4 and hot[0] == 0.5
    assert len(L.Bins((many,)).coarse(32).edges[0]) == 31


def test_trees_save_and_load(rows, tmp_path):
    blocks, bins, counts = packed(rows)
    model = fitted.FittedTrees.of(L.boost(blocks, bins, counts, np.array([0.5, 0, 0]), [5] * 3, L.BoostSettings(rounds=3))[0], bins, 5, False).named("gbt", "features")
    model.write().overwrite().save(str(tmp_path / "m"))
    again = fitted.FittedTrees.load(str(tmp_path / "m"))
    got = {r.id: (r.prob_gbt[1], r.raw_gbt[1], r.features) for r in again.transform(rows).collect()}
    assert all(p == pytest.approx(model.predictProbability(f)[1]) and raw == pytest.approx(model.predictRaw(f)[1]) for p, raw, f in got.values())
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)


def plain_logistic(x, y, c, balance, standardise):
    """Damped steps on the full problem, to the end."""
    m, s = (x.mean(0), x.std(0)) if standardise else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    s = np.where(s == 0, np.inf, s)
    z = np.column_stack([(x - m) / s, np.ones(len(y))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balance else np.ones(len(y))
    ridge, b = np.append(np.full(x.shape[1], 1 / c), 0), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        b += 0.5 * np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), z.T @ (w * (y - p)) - ridge * b)
    return b


@pytest.mark.parametrize("how", [{}, {"balance": False, "standardise": False}])
def test_newton_equals_a_plain_solver(rows, data, how):
    x, y, g = data
    use = {"features": "features", **how}
    found = newton.fit_logistics(rows.withColumn("features", array_to_vector(F.slice("x", 1, 4))), "y", fits(), 0.1, **use)
    for fit, take in zip(found, (g >= 0, g != 0, g == 1)):
        want = plain_logistic(x[take][:, :4], y[take], 0.1, how.get("balance", True), how.get("standardise", True))
        assert np.abs(np.append(fit.coefficients, fit.intercept) - want).max() < 1e-6 and fit.steps < 15
        assert np.allclose(x[take][:, :4] @ fit.slopes + fit.offset, ((x[take][:, :4] - fit.mean) / fit.deviation) @ fit.coefficients + fit.intercept)


def test_newton_on_separable_and_constant_columns(spark):
    frame = materialise(spark.createDataFrame([(int(i >= 20), [float(i), 7.0]) for i in range(40)], "y int, x array<double>").withColumn("features", array_to_vector("x")), "rows")
    fit = newton.fit_logistics(frame, "y", [F.lit(True)], 0.1)[0]
    assert fit.coefficients[0] > 0.5 and fit.coefficients[1] == pytest.approx(0, abs=1e-9) and np.isfinite(fit.intercept)
    with pytest.raises(ValueError, match="no rows"):
        newton.fit_logistics(frame, "y", [F.lit(True), F.lit(False)], 0.1)


def test_bundles_keep_the_sums_of_their_features():
    rng = np.random.default_rng(6)
    counts = np.array([2, 256, 1, 7, 2, 130, 3, 2, 16, 16, 255])
    bins = np.stack([rng.integers(0, c, 900) for c in counts]).astype(np.uint8)
    bundles = L._Bundles.of(counts)
    assert sorted(f for m in bundles.members for f in m) == list(range(len(counts))) and len(bundles.members) < 7
    slot, value = rng.integers(0, 3, 900), rng.integers(-9, 9, (2, 900))
    sums = np.zeros((len(bundles.members), 2, 3, L.BUNDLE), dtype=np.int64)
    for code, out in zip(bundles.codes(bins), sums):
        for kind in range(2):
            np.add.at(out[kind], (slot, code.astype(int)), value[kind])
    starts = np.append(0, np.cumsum(counts))
    want = np.zeros((3, 2, starts[-1]), dtype=np.int64)
    for f, start in enumerate(starts[:-1]):
        for kind in range(2):
            np.add.at(want[:, kind], (slot, start + bins[f].astype(int)), value[kind])
    assert (bundles.apart(sums) == want).all()


def test_a_whole_fit_never_starts_again_at_the_root(rows, monkeypatch):
    """Its task keeps the node of every row: no row walks down the tree for each level, and fits of half a million rows are grown so."""
    import pickle
    from functools import partial

    assert L.WHOLE_ROWS >= 500_000
    blocks, bins, counts = packed(rows)
    how, forest = L.BoostSettings(rounds=4, depth=4, least_rows=10), L.ForestSettings(trees=5, depth=4, least_rows=10)
    boosted, grown = (f(blocks, bins, counts, *rest, whole_rows=0)[0] for f, rest in ((L.boost, (np.zeros(3), [5] * 3, how)), (L.grow_forests, (forest,))))
    dealt = [(0, L._only(np.array([0]), pickle.loads(pickle.dumps(b)))) for b in blocks.collect()]

    def walk(*_):
        raise AssertionError("walked from the root")

    monkeypatch.setattr(L.Trees, "walk", walk)
    layout = L._Layout.of(bins, int(counts.sum(axis=1).max()))
    here = partial(L._boost_here, layout=layout, weights=L.balanced(counts), start=np.zeros(3), widths=[5] * 3, settings=how)
    same([boosted], [one for _, one in L._each(here, 0, iter(dealt))])

    class Dealt:
        def mapPartitionsWithIndex(self, f):
            self.found = list(f(0, iter(dealt)))
            return self

        def collect(self):
            return self.found

    monkeypatch.setattr(L, "_by_fit", lambda *_: Dealt())
    same([grown], L.grow_forests(blocks, bins, counts[:1], forest))
