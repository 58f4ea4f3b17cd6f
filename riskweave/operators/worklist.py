"""The periodic outreach list: the top share of each month's scored rows, ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweave.functions.columns import risk_level
from riskweave.operators.features import ID, MONTH
from riskweave.operators.ranking import global_row_number

# Fixed value: per cent of a month's rows that are flagged for review.
FLAGGED_PERCENT = 15


def monthly_worklist(
    scored: DataFrame, score: str = "y_prob", month: str = MONTH, tie: str = ID, percent: int = FLAGGED_PERCENT
) -> DataFrame:
    """Rows in the top per cent of their month by score, with rank and risk level."""
    ranked = global_row_number(scored.select(tie, month, score), score, tie, [month], out="place", total="__n")
    flagged = ranked.filter(F.col("place") <= F.floor(F.col("__n") * percent / 100))
    return flagged.drop("__n").withColumn("level", risk_level(score))
