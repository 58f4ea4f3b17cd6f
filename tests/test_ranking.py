import numpy as np
from decimal import Decimal

import pytest
from brute import tiles
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from riskweave.operators import ranking


def skewed(spark, n=4000, seed=3):
    """A third of all rows share one score; ids of the tied rows are clustered."""
    rng = np.random.default_rng(seed)
    score = np.round(rng.random(n), 2)
    score[: n // 3] = 0.37
    rows = [(int(i), float(s), int(rng.random() < 0.3), ["a", "b", None][i % 3]) for i, s in enumerate(score)]
    return spark.createDataFrame(rows, "id long, p double, y int, grp string").repartition(7)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [[], ["grp"]])
def test_row_number_equals_window(spark, descending, by):
    df = skewed(spark)
    order = [F.desc("p") if descending else F.asc("p"), F.asc("id")]
    got = ranking.global_row_number(df, "p", "id", by, descending, total="n")
    want = Window.partitionBy(*by)
    wrong = got.withColumn("w", F.row_number().over(want.orderBy(*order))).withColumn("m", F.count("*").over(want))
    assert wrong.filter((F.col("w") != F.col("rn")) | (F.col("m") != F.col("n"))).count() == 0
    assert got.count() == df.count()


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 60])
def test_small_inputs(spark, n):
    df = spark.createDataFrame([(i, 0.5) for i in range(n)], "id long, p double")
    got = [r.tile for r in ranking.global_ntile(df, 10, "p", "id").orderBy("id").collect()]
    assert got == tiles(n, 10)


def test_hot_score_is_cut_into_cells(spark):
    df = skewed(spark, 6000)
    layout = ranking.plan_layout(df, "p", "id", buckets=24)
    rows = ranking.bucketed(df, "p", layout.edges, "__b")
    rows = ranking.bucketed(rows, "id", layout.tie_edges, "__t").withColumn("c", ranking._cell("p", layout, True))
    largest = rows.groupBy("c").count().agg(F.max("count")).first()[0]
    assert largest < 6000 / 3 / 2
    assert rows.select("c").distinct().count() <= layout.max_cells


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_unplaced_score_is_an_error(spark, bad):
    df = spark.createDataFrame([(i, i / 100 if i else bad, 1) for i in range(100)], "id long, p double, y int")
    with pytest.raises(Exception, match="null in p|NaN"):
        ranking.global_row_number(df, "p", "id").collect()
    with pytest.raises(Exception, match="null in p"):
        ranking.score_curve(df, "p", "y").collect()


@pytest.mark.parametrize("descending", [True, False])
def test_tile_totals(spark, descending, many_buckets):
    df = skewed(spark)
    order = [F.desc("p") if descending else F.asc("p"), F.asc("id")]
    want = (
        df.withColumn("tile", F.ntile(10).over(Window.orderBy(*order)))
        .groupBy("tile")
        .agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.round(F.sum("p"), 6).alias("s"))
    )
    got = ranking.tile_totals(df, "p", "y", "id", ranking.ntile_of(10), 10, descending=descending)
    got = got.select("tile", "n", "pos", F.round("score_sum", 6).alias("s"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_curve_equals_one_window(spark, many_buckets):
    df = skewed(spark)
    runs = df.groupBy("grp", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    group = Window.partitionBy("grp")
    upto = group.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    want = runs.select(
        "grp", "p", "n", "pos", F.sum("n").over(upto), F.sum("pos").over(upto), F.sum("n").over(group), F.sum("pos").over(group)
    )
    got = ranking.score_curve(df, "p", "y", ["grp"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("kind,value", [("bigint", lambda i: 2**60 + i // 3), ("decimal(38,18)", lambda i: Decimal(i // 3) / 10**18 + 7)])
def test_scores_beyond_doubles(spark, kind, value):
    """Scores that share a double keep their own order; equal ones go by the tie-break."""
    rows = [(i, value(i if i % 4 else 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, f"id long, s {kind}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for descending in (True, False):
            got = {r.id: r.rn for r in ranking.global_row_number(df, "s", "id", descending=descending).collect()}
            want = sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0]))
            assert got == {r[0]: n for n, r in enumerate(want, 1)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _records_read(spark, job):
    """Rows that scans of the given job's files read: counted by an accumulator in the source."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    job(lambda df: df.mapInArrow(count, df.schema))
    return seen.value


@pytest.mark.parametrize("name", ["metrics_full", "decile_lift", "worklist", "calibration_half"])
def test_the_source_is_read_once(spark, name):
    from riskweave.operators import metrics, split, worklist

    rows = [(i, 202001 + i % 5, (i * 7919 % 1000) / 1000, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "patientID long, EncMonth int, y_prob double, y boolean").withColumn("y_true", F.col("y").cast("int")).drop("y")
    jobs = {
        "metrics_full": metrics.evaluate, "decile_lift": metrics.lift_table, "worklist": worklist.monthly_worklist,
        "calibration_half": lambda x: split.calibration_half(x.select("patientID", "EncMonth")),
    }
    assert _records_read(spark, lambda counted: jobs[name](counted(df)).collect()) == 3000


def test_no_single_task_over_rows(spark, many_buckets):
    """Only per-bucket totals may meet in one task: no row column reaches such an exchange."""
    df = skewed(spark)
    plan = ranking.global_ntile(df, 10, "p", "id")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 3])
            assert "HashAggregate" in below and "id#" not in below


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.1, 0.2, 0.2, 0.5, 0.9]), min_size=1, max_size=40), st.integers(1, 12))
def test_tile_sizes(spark, scores, t):
    df = spark.createDataFrame(list(enumerate(scores)), "id long, p double")
    sizes = [r["count"] for r in ranking.global_ntile(df, t, "p", "id").groupBy("tile").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(scores)


def test_tile_formula(spark):
    cases = [(r, n, t) for n in range(1, 40) for t in (1, 3, 7, 10, 12) for r in range(1, n + 1)]
    df = spark.createDataFrame(cases, "r long, n long, t int")
    for t in (1, 3, 7, 10, 12):
        rows = df.filter(F.col("t") == t).select("r", "n", ranking.ntile_of(t)(F.col("r"), F.col("n")).alias("g"))
        assert all(x.g == tiles(x.n, t)[x.r - 1] for x in rows.collect())


def test_long_ids_keep_their_digits(spark, many_buckets):
    big = 2**60
    df = spark.createDataFrame([(big + i, 0.5, i % 2) for i in range(50)], "id long, p double, y int")
    got = ranking.tile_totals(df, "p", "y", "id", ranking.top_share_of(10), 2).orderBy("tile").collect()
    assert [(r.tile, r.n, r.pos) for r in got] == [(1, 5, 2), (2, 45, 23)]
    assert df.filter(ranking.at_most_nth(df, "id", 7)).agg(F.max("id")).first()[0] == big + 6


def test_text_ids(spark, many_buckets):
    rows = [(f"patient-{i:06d}", 0.5 if i % 3 else i / 900, i % 2, 202001) for i in range(900)]
    df = spark.createDataFrame(rows, "patientID string, p double, y int, EncMonth int")
    order = Window.orderBy(F.desc("p"), F.xxhash64("patientID"), "patientID")
    got = ranking.global_row_number(df, "p", "patientID").withColumn("w", F.row_number().over(order))
    assert got.filter("w <> rn").count() == 0
    want = df.withColumn("tile", F.ntile(10).over(order)).groupBy("tile").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    totals = ranking.tile_totals(df, "p", "y", "patientID", ranking.ntile_of(10), 10).select("tile", "n", "pos")
    assert sorted(totals.collect()) == sorted(want.collect())
    from riskweave.operators.split import calibration_half

    assert calibration_half(df).filter("half = 'calibrate'").count() == 450


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_calibration_half(spark, n, many_buckets):
    from riskweave.operators.split import calibration_half

    rows = [(i * 7919 % 1009, 202001 + (i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "patientID long, EncMonth int")
    got = {r.patientID for r in calibration_half(df).filter("half = 'calibrate'").collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[: n // 2]}
