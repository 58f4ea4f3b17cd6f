"""Scoring and auditing rows as they arrive.

The batch operators are reused: the feature view and a fitted model hold no state. The
audit keeps additive sums per period and group, one small table per micro-batch, and adds them up on
reading. A row that comes late is added to its own period like any other: no watermark, no loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweave.operators.fairness import GROUP_GAP_TOLERANCE
from riskweave.operators.features import build_features
from riskweave.operators.groups import exclusive_label

# Fixed value: length of an audit period.
AUDIT_PERIOD = "90 days"


def score_stream(patients: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Arriving patient rows through the feature view and a fitted scorer."""
    return scorer(build_features(patients).withColumn("subgroup", exclusive_label()))


def audit_sums(scored: DataFrame, at: str, group: str, score: str = "y_prob", label: str = "y_true", period: str = AUDIT_PERIOD) -> DataFrame:
    """Per period and group: rows, positives and score sum of the rows given."""
    start = F.date_from_unix_date(F.floor(F.unix_seconds(F.window(at, period)["start"]) / 86400).cast("int"))
    rows = scored.select(start.alias("period_start"), F.col(group), F.col(label).cast("double").alias("__y"), F.col(score).cast("double").alias("__p"))
    return rows.groupBy("period_start", group).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y_sum"), F.sum("__p").alias("p_sum"))


def audit_report(sums: DataFrame, group: str) -> DataFrame:
    """Per period and group: rows, actual rate, mean score, gap and flag, over all sums of it."""
    total = sums.groupBy("period_start", group).agg(F.sum("n").alias("n"), F.sum("y_sum").alias("y"), F.sum("p_sum").alias("p"))
    gap = (F.col("y") - F.col("p")) / F.col("n")
    return total.select(
        group, "n", (F.col("y") / F.col("n")).alias("actual_rate"), (F.col("p") / F.col("n")).alias("mean_prob"),
        gap.alias("cal_gap"), (F.abs(gap) > GROUP_GAP_TOLERANCE).alias("flagged"), "period_start",
    )


def audit_windows(
    scored: DataFrame, at: str, group: str, score: str = "y_prob", label: str = "y_true", period: str = AUDIT_PERIOD
) -> DataFrame:
    """The audit of a whole table."""
    return audit_report(audit_sums(scored, at, group, score, label, period), group)


def write_batches(
    df: DataFrame, path: str, checkpoint: str, of_batch: Callable[[DataFrame], DataFrame] = lambda batch: batch
) -> StreamingQuery:
    """Write what ``of_batch`` makes of each micro-batch under its number; a repeated batch replaces itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        of_batch(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        df.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
