"""Profiling a patient table: sizes, rates, nulls, spans and correlations.

Each report is one aggregation pass; reports over several columns or groups share
the pass instead of reading the table once each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.columns import month_start, share
from riskweave.operators.features import MONTH, TARGET
from riskweave.operators.groups import explode_memberships, overlap_conditions

# Printed name of each column whose nulls are profiled, and the
# features whose correlation with the outcome is reported.
NULL_PROFILE = {
    "null_adi": "ADINatrank",
    "null_cahpi": "CAHPIPercentile",
    "null_dist": "straight_line_distance_miles",
    "null_race": "DerivedRaceEthnicity",
    "null_target": "Outcome",
}
CORRELATED = {
    "r_adi": "ADINatrank",
    "r_cahpi": "CAHPIPercentile",
    "r_op12": "last_12months_officevisit_count",
    "r_glaucoma": "flag_glaucoma",
    "r_diabetes": "flag_diabetes",
    "r_glaucoma_diabetic": "flag_glaucoma_diabetic",
    "r_cardio": "Specialty_cardiology",
    "r_distance": "straight_line_distance_miles",
    "r_chronic_count": "last_12months_chronic_count",
}


def _rate(target: str) -> Column:
    return F.avg(F.col(target).cast("double"))


def cohort_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows, outcome rate over known outcomes, and events."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        _rate(target).alias("rate"),
        F.coalesce(F.sum(F.col(target).cast("bigint")), F.lit(0)).alias("events"),
    )


def overlap_rates(df: DataFrame, target: str = TARGET, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Size and rate of groups that may overlap, highest rate first, from one scan."""
    long = explode_memberships(df, conditions or overlap_conditions())
    return (
        long.groupBy("subgroup")
        .agg(F.count(F.lit(1)).alias("n"), _rate(target).alias("rate"))
        .orderBy(F.desc("rate"), "subgroup")
    )


def rate_by(df: DataFrame, column: str, target: str = TARGET, by_rate: bool = True) -> DataFrame:
    """Size and rate per value of one column; null is a value of its own."""
    out = df.groupBy(F.col(column).alias("grp")).agg(F.count(F.lit(1)).alias("n"), _rate(target).alias("rate"))
    return out.orderBy(F.desc("rate"), "grp") if by_rate else out.orderBy("grp")


def rate_by_dimensions(df: DataFrame, columns: Sequence[str], target: str = TARGET) -> DataFrame:
    """The one-column reports of several columns together, from one grouping-sets pass."""
    named = df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.col(target).alias("__y"))
    grouped = named.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("n"), _rate("__y").alias("rate")
    )
    # The grouping id has a 0 bit for the column in use, the first column highest.
    full = (1 << len(columns)) - 1
    which = reduce(
        lambda acc, i: acc.when(F.col("__set") == full - (1 << (len(columns) - 1 - i)), F.lit(columns[i])),
        range(1, len(columns)),
        F.when(F.col("__set") == full - (1 << (len(columns) - 1)), F.lit(columns[0])),
    )
    return grouped.select(
        which.alias("dimension"), F.coalesce(*columns, F.lit("Unknown")).alias("grp"), "n", "rate"
    )


def null_profile(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Per profiled column: rows, nulls and percent null."""
    columns = columns or NULL_PROFILE
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(name) for name, c in columns.items()]
    )
    long = counted.select(
        "n",
        F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("nulls")) for name in columns])).alias("r"),
    )
    return long.select(
        F.col("r.name").alias("column_name"), "n", F.col("r.nulls").alias("nulls"),
        (share(F.col("r.nulls"), F.col("n")) * 100).alias("pct"),
    )


def date_span(df: DataFrame, month: str = MONTH) -> DataFrame:
    """First and last month and the number of distinct months."""
    start = month_start(month)
    return df.agg(
        F.min(start).alias("earliest"), F.max(start).alias("latest"), F.count_distinct(start).alias("n_months")
    )


def correlations(df: DataFrame, features: dict[str, str] | None = None, target: str = TARGET) -> DataFrame:
    """Pearson correlation of each feature with the target; null for a constant feature.

    A null value leaves out its own pair only. ``corr`` itself fails on a constant
    column, so covariance and spreads are divided under a guard.
    """
    features = features or CORRELATED
    y = F.col(target).cast("double")
    aggs = []
    for name, c in features.items():
        x = F.when(y.isNotNull(), F.col(c).cast("double"))
        paired = F.when(x.isNotNull(), y)
        spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(paired))
        aggs.append(F.try_divide(F.covar_pop(x, paired), spread).alias(name))
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("r")) for n in features])
    return wide.select(F.explode(pairs).alias("p")).select("p.feature", "p.r")


def flag_totals(df: DataFrame, flags: Sequence[str] = ("flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic")) -> DataFrame:
    return df.agg(*[F.sum(F.col(c).cast("bigint")).alias(c) for c in flags])
