"""Scores and the outcomes that come up to a year later.

A score matures when its outcome is seen or when no outcome can come any more. The two streams are joined by key within the
horizon: the state holds a score until then, by event time, and forgets it afterwards. What no batch has given out yet is
immature and is told apart from scores without an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: how long after a score its outcome still counts.
HORIZON = "365 days"
DISORDER = "30 days"


def join_outcomes(scored: DataFrame, outcomes: DataFrame, key: str, at: str, observed: str, horizon: str = HORIZON, disorder: str = DISORDER) -> DataFrame:
    """Scored rows that have matured, with ``outcome`` 1 or 0; streams or tables.

    ``scored`` has one row per key, ``outcomes`` the first event of a key (key and ``observed``). Rows may come out of order by ``disorder``. A stream
    gives a row with an event at once, one without when its horizon has passed in both streams.
    """
    if scored.isStreaming:
        scored, outcomes = scored.withWatermark(at, disorder), outcomes.withWatermark(observed, disorder)
    seen = outcomes.select(F.col(key).alias("__key"), F.col(observed).alias("__observed"))
    within = (F.col("__observed") >= F.col(at)) & (F.col("__observed") <= F.col(at) + F.expr(f"INTERVAL {horizon}"))
    joined = scored.join(seen, (F.col(key) == F.col("__key")) & within, "left")
    return joined.withColumn("outcome", F.col("__key").isNotNull().cast("int")).drop("__key", "__observed")


def maturity_report(scored: DataFrame, matured: DataFrame, key: str, period: str, score: str = "y_prob") -> DataFrame:
    """Per period: scores, how many have matured, events, and the mean score and calibration gap of the matured ones.

    Rows that have not matured are counted as immature and enter neither mean.
    """
    known = matured.select(F.col(key).alias("__key"), "outcome")
    rows = scored.join(known, scored[key] == F.col("__key"), "left").drop("__key")
    ripe = F.col("outcome").isNotNull()
    counted = rows.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ripe).alias("matured"), F.count_if(~ripe).alias("immature"),
        F.sum("outcome").cast("bigint").alias("events"), F.avg(F.when(ripe, F.col(score))).alias("mean_prob"), F.avg("outcome").alias("actual_rate"),
    )
    return counted.withColumn("cal_gap", F.col("actual_rate") - F.col("mean_prob"))
