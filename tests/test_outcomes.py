"""Outcomes that come later, in several files and out of order; recalibration from sums."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import isotonic
from riskweave.session import materialise
from riskweave.streaming import outcomes
from riskweave.streaming.scoring import write_batches

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2020, 1, 1)


def test_stream_in_pieces_equals_the_batch_join(spark, tmp_path):
    rng = random.Random(4)
    scores = [(i, START + rng.randrange(900) * DAY, rng.random()) for i in range(400)]
    events = [(i, at + rng.choice([-5, 0, 3, 200, 365, 366, 500]) * DAY) for i, at, _ in scores if rng.random() < 0.6]
    # Files in the order of their days, rows within them and neighbouring files mixed up by less than the disorder.
    late = lambda at: at + rng.uniform(0, 25) * DAY
    for name, rows, schema in (("scores", scores, "key long, at timestamp, y_prob double"), ("events", events, "key long, observed timestamp")):
        for number, r in enumerate(_pieces(sorted(rows, key=lambda r: late(r[1])), 6)):
            spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={number}"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    s, e = read("scores", "key long, at timestamp, y_prob double"), read("events", "key long, observed timestamp")
    matured = outcomes.join_outcomes(s, e, "key", "at", "observed", disorder="200 days 12 hours")
    write_batches(matured.select("key", "outcome"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.key: r.outcome for r in spark.read.schema("key long, outcome int").parquet(str(tmp_path / "out")).collect()}
    seen = dict(events)
    mark = min(max(at for _, at, _ in scores), max(o for _, o in events)) - 200.5 * DAY
    want = {}
    for i, at, _ in scores:
        if i in seen and at <= seen[i] <= at + 365 * DAY:
            want[i] = 1
        elif at + 365 * DAY < mark:
            want[i] = 0
    assert got == want and 0 < len(want) < len(scores)
    # The report tells immature rows apart, and the batch join agrees with the events.
    every = spark.createDataFrame([(*r, "all") for r in scores], "key long, at timestamp, y_prob double, period string")
    report = outcomes.maturity_report(every, spark.createDataFrame(list(got.items()), "key long, outcome int"), "key", "period").first()
    assert (report.n, report.matured, report.immature, report.events) == (400, len(want), 400 - len(want), sum(want.values()))
    batch = outcomes.join_outcomes(every, spark.createDataFrame(events, "key long, observed timestamp"), "key", "at", "observed")
    assert batch.agg(F.sum("outcome")).first()[0] == sum(want.values())


def _pieces(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_refit_from_sums_equals_a_refit_on_all_rows(spark):
    rng = random.Random(8)
    months = [202011, 202012, 202101, 202102, 202104]
    rows = [(m, round(rng.random(), 1), int(rng.random() < 0.4)) for m in months for _ in range(60)] + [(202101, None, 1), (202101, 0.5, None)]
    df = spark.createDataFrame(rows, "m int, s double, y int")
    halves = df.randomSplit([0.5, 0.5], seed=1)
    state = isotonic.merged_states(*[isotonic.calibration_state(h, "s", "y", "m") for h in halves])
    whole = {tuple(r) for r in isotonic.calibration_state(df, "s", "y", "m").collect()}
    assert {tuple(r) for r in state.collect()} == whole
    got = isotonic.recalibrated(materialise(state, "state"), 3).collect()
    number = lambda m: m // 100 * 12 + m % 100
    assert {r.as_of for r in got} == set(months)
    for m in months:
        window = df.filter(F.col("m").isin([x for x in months if 0 <= number(m) - number(x) < 3]))
        want = sorted((b.low, b.high, pytest.approx(b.fitted), b.n) for b in isotonic.isotonic_blocks(window, "s", "y").collect())
        assert sorted((r.low, r.high, r.fitted, r.n) for r in got if r.as_of == m) == want
