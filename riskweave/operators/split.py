"""Splits without leakage: by time, by row order, and by hashed fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweave.functions.columns import month_start
from riskweave.operators.features import ID, MONTH, TARGET
from riskweave.operators.ranking import at_most_nth
from riskweave.session import materialise

# Fixed value: part of the distinct months that go to training.
TRAIN_PERCENT = 85


def month_assignment(df: DataFrame, month: str = MONTH, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """One row per distinct month with its split: the first int(share * n) months train.

    The window runs over distinct months only, a few hundred rows at most.
    """
    months = df.select(F.col(month)).distinct()
    place = F.row_number().over(Window.partitionBy().orderBy(month))
    count = F.count(F.lit(1)).over(Window.partitionBy())
    cut = F.floor(count * train_percent / 100)
    return months.select(month, F.when(place <= cut, "train").otherwise("val").alias("split"))


def first_validation_month(df: DataFrame, month: str = MONTH, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """One row, one value: the earliest month of the validation side."""
    assigned = month_assignment(df, month, train_percent)
    return assigned.agg(F.min(F.when(F.col("split") == "val", F.col(month))).alias("first_val"))


def temporal_split(df: DataFrame, month: str = MONTH, train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``split`` (train / val).

    The cut is a scalar subquery, so the rows themselves are neither shuffled nor joined.
    """
    cut = first_validation_month(df, month, train_percent).scalar()
    return df.withColumn("split", F.when(F.col(month) >= cut, "val").otherwise("train"))


def split_summary(df: DataFrame, month: str = MONTH, target: str = TARGET) -> DataFrame:
    """Rows, outcome rate and month range of each split."""
    start = month_start(month)
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(target).cast("double")).alias("rate"),
        F.min(start).alias("first_month"),
        F.max(start).alias("last_month"),
    )


def calibration_half(df: DataFrame, month: str = MONTH, tie: str = ID, out: str = "half", written: bool = False) -> DataFrame:
    """Mark the first n // 2 rows in (month, id) order ``calibrate``, the rest ``evaluate``.

    Only the row at the cut is looked for: row counts per month name its month, and its
    id is an order statistic of that month. The marking itself moves no rows. All steps read
    one table, which is the frame itself if the caller says that it is ``written``.
    """
    df = df if written else materialise(df, "halves")
    counts = df.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("n").over(everything.orderBy(month).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The one month that the cut falls into, and how many of its rows come before it.
    placed = counts.select(F.col(month).alias("m"), "n", before.alias("before"), F.floor(F.sum("n").over(everything) / 2).alias("half"))
    at = placed.filter((F.col("before") < F.col("half")) & (F.col("before") + F.col("n") >= F.col("half"))).first()
    mark = F.lit("evaluate")
    if at is not None:
        first = at_most_nth(df.filter(F.col(month) == at["m"]), tie, at["half"] - at["before"])
        early = (F.col(month) < at["m"]) | ((F.col(month) == at["m"]) & first)
        mark = F.when(early, "calibrate").otherwise("evaluate")
    return df.withColumn(out, mark)


def fold(key: str = ID, folds: int = 5) -> Column:
    """Fold number from a hash of the key: stable under any partitioning."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")
