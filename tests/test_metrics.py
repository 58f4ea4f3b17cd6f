import numpy as np
import pytest
from brute import record
from pyspark.sql import functions as F

from riskweave.operators import fairness, metrics, thresholds


def frame(spark, rows):
    return spark.createDataFrame(rows, "patientID long, y_true int, y_prob double, g string")


def check(got, want):
    for k, v in want.items():
        if v is None:
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(v, abs=1e-9), k


def rows_of(kind, n=300, seed=1):
    rng = np.random.default_rng(seed)
    p = {
        "tied": np.round(rng.random(n), 1),
        "continuous": rng.random(n),
        "equal": np.full(n, 0.4),
        "hot": np.where(np.arange(n) % 3 == 0, 0.61, np.round(rng.random(n), 2)),
    }[kind]
    y = (rng.random(n) < 0.3).astype(int)
    return [(int(i), int(a), float(b), "x" if i % 4 else None) for i, (a, b) in enumerate(zip(y, p))]


@pytest.mark.parametrize("kind", ["tied", "continuous", "equal", "hot"])
@pytest.mark.parametrize("path", ["one window", "buckets"])
def test_record_matches_brute_force(spark, kind, path, request):
    if path == "buckets":
        request.getfixturevalue("many_buckets")
    rows = rows_of(kind)
    got = metrics.evaluate(frame(spark, rows)).first()
    ids, y, p, _ = zip(*rows)
    check(got, record(y, p, ids))


def test_groups_with_null_key(spark, many_buckets):
    rows = rows_of("hot", 400)
    got = {r.g: r for r in metrics.evaluate(frame(spark, rows), by=["g"]).collect()}
    assert set(got) == {"x", None}
    for g in got:
        ids, y, p, _ = zip(*[r for r in rows if r[3] == g])
        check(got[g], record(y, p, ids))


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_few_rows(spark, n):
    rows = rows_of("continuous", n, seed=5)
    ids, y, p, _ = zip(*rows)
    check(metrics.evaluate(frame(spark, rows)).first(), record(y, p, ids))


def test_one_class_has_status_and_no_auroc(spark):
    rows = [(i, 0, i / 10, "x") for i in range(8)]
    got = metrics.evaluate(frame(spark, rows)).first()
    assert got.status == "one class" and got.auroc is None and got.auprc is None and got.capture_top_decile == 0
    assert metrics.quick_record(frame(spark, rows)).count() == 0


def test_order_of_input_does_not_matter(spark):
    df = frame(spark, rows_of("hot"))
    a = metrics.evaluate(df.repartition(1)).first()
    b = metrics.evaluate(df.repartition(9, F.rand(3))).first()
    for c in a.asDict():
        assert a[c] == pytest.approx(b[c]), c


def test_auroc_mirrors_and_ignores_monotone_change(spark):
    df = frame(spark, rows_of("tied"))
    auroc = lambda d: metrics.evaluate(d, top=False).first().auroc
    base = auroc(df)
    assert auroc(df.withColumn("y_prob", 1 - F.col("y_prob"))) == pytest.approx(1 - base)
    assert auroc(df.withColumn("y_prob", F.col("y_prob") ** 3 / 2)) == pytest.approx(base)


def test_zero_division_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    got = metrics.confusion(df).first()
    assert (got.sensitivity, got.ppv, got.f1, got.specificity) == (0, 0, 0, 1)


def test_thresholds_agree_with_scan(spark, many_buckets):
    rows = rows_of("hot", 500)
    _, y, p, _ = map(np.asarray, zip(*rows))
    got = {(r.kind, r.target): r for r in thresholds.threshold_table(frame(spark, rows)).collect()}
    for (kind, target), r in got.items():
        if kind == "sensitivity":
            best = max(t for t in np.unique(p) if y[p >= t].sum() / y.sum() >= target)
            assert r.threshold == best
        elif kind == "top_cut":
            assert r.threshold == pytest.approx(np.percentile(p, 90))
        assert r.tp == y[p >= r.threshold].sum()
        assert r.flagged_pct == pytest.approx((p >= r.threshold).mean() * 100)
    assert ("recommended", 0.3) in got


def test_repeated_thresholds_are_given_once(spark):
    df = frame(spark, [(i, i % 2, 0.5, "x") for i in range(20)])
    kinds = [r.kind for r in thresholds.threshold_table(df).collect()]
    assert sorted(kinds) == ["recommended", "sensitivity", "top_cut"]


def test_no_events_falls_back_to_top_cut(spark):
    df = frame(spark, [(i, 0, i / 20, "x") for i in range(20)])
    got = {r.kind: r for r in thresholds.threshold_table(df, targets=(0.5,)).collect()}
    assert got["recommended"].threshold == got["top_cut"].threshold


def test_equity_drops_small_unknown_and_one_class_groups(spark):
    rows = [(i, i % 2, (i % 10) / 10, "big") for i in range(40)] + [(100 + i, i % 2, 0.5, "small") for i in range(10)]
    rows += [(200 + i, 0, 0.5, "flat") for i in range(40)] + [(300 + i, 1, 0.5, None) for i in range(40)]
    table = fairness.equity_table(frame(spark, rows), dims={"g": "G", "absent": "A"})
    assert [(r.dimension, r.group, r.n) for r in table.collect()] == [("G", "big", 40)]


def test_small_groups_are_marked(spark):
    got = metrics.guarded(metrics.evaluate(frame(spark, rows_of("tied", 40)), by=["g"]), 30).collect()
    assert {(r.g, r.status) for r in got} == {("x", "ok"), (None, "too small")}


def test_calibration_gap_keeps_null_group(spark):
    rows = [(1, 1, 0.9, None), (2, 0, 0.1, "x"), (3, 1, 0.2, "x")]
    got = {r.g: r for r in fairness.calibration_gap(frame(spark, rows), "g").collect()}
    assert got[None].cal_gap == pytest.approx(0.1) and got["x"].flagged
