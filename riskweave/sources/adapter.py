"""Deterministic mapping from the supplied star-schema tables to the clinical inputs.

One order stands for one patient snapshot. Only the joins that the asked-for
columns need are made: nothing but ``orders`` is read for the order-level
columns, ``lineitem`` is read only for visit counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.functions.columns import binarise, flag
from riskweave.operators.features import (
    AREA_GROUPS, CANCER_SOURCES, CATEGORIES, CONDITION_SOURCES, SOURCE_COLUMNS, SPECIALTIES, VISITS, build_features,
)
from riskweave.operators.groups import exclusive_label



# Columns read from each supplied table; a given schema saves reading footers first.
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _null_every(n: int, value: Column) -> Column:
    """Value, but null on every n-th order."""
    return F.when(F.col("o_orderkey") % n != 0, value)


def _order_columns() -> dict[str, Column]:
    """The input table's column names, each over columns of an order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    small = lambda e: e.cast("int")
    return {
        "patientID": k,
        "EncMonth": small(F.year("o_orderdate") * 100 + F.month("o_orderdate")),
        "Outcome": _null_every(97, flag(F.col("o_orderstatus") == "F")),
        "cms_ccw_glaucoma_36": flag(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
        "cms_ccw_sensory_blindness_and_visual_impairment_36": flag(c % 4 == 0),
        "cms_ccw_cataract_36": flag(c % 6 == 1),
        "cms_ccw_hypertension_36": flag(k % 2 == 0),
        "cms_ccw_obesity_36": flag(k % 3 == 1),
        "cms_ccw_ischemic_heart_disease_36": flag(c % 9 == 0),
        "cms_ccw_atrial_fibrillation_36": flag(k % 8 == 3),
        "cms_ccw_depression_36": flag(k % 5 == 2),
        "cms_ccw_anxiety_disorders_36": flag(c % 10 == 3),
        "cms_ccw_tobacco_use_36": flag(c % 5 == 1),
        "cms_ccw_lung_cancer_36": flag(k % 7 == 0),
        "cms_ccw_colorectal_cancer_36": flag(k % 11 == 3),
        "cms_ccw_female_male_breast_cancer_36": flag(k % 13 == 5),
        "ADINatrank": _null_every(13, (k % 101).cast("double")),
        "ADIStaterank": _null_every(13, (c % 10 + 1).cast("double")),
        "CAHPIPercentile": F.when(c % 17 != 0, (c % 101).cast("double")),
        "straight_line_distance_miles": _null_every(29, F.col("o_totalprice") / 10000),
        "ADINatRankQuintile": _null_every(13, small(F.floor((k % 101) / 21) + 1)),
        "CAHPIQuartile": F.when(c % 17 != 0, small(F.floor((c % 101) / 26) + 1)),
        "sex": _null_every(23, F.when(c % 2 == 0, "Female").otherwise("Male")),
    }


def _customer_columns() -> dict[str, Column]:
    return {
        "cms_ccw_diabetes_36": flag(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
        "cms_ccw_chronic_kidney_disease_36": flag(F.col("c_nationkey") % 3 == 0),
        "cms_ccw_heart_failure_36": flag(F.col("c_nationkey") % 5 == 0),
        "DerivedRaceEthnicity": _null_every(11, F.col("c_mktsegment")),
    }


def _burden_columns(known: dict[str, Column]) -> dict[str, Column]:
    counted = [
        "hypertension", "obesity", "chronic_kidney_disease", "heart_failure",
        "ischemic_heart_disease", "atrial_fibrillation", "depression",
    ]
    chronic = reduce(lambda a, b: a + b, [known[f"cms_ccw_{name}_36"] for name in counted])
    diagnoses = chronic + known["cms_ccw_cataract_36"] * 2 + (F.col("o_orderkey") % 4).cast("int")
    return {"last_12months_chronic_count": chronic, "last_12months_diagnosis_count_ccw": diagnoses}


_VISIT_COLUMNS = VISITS + SPECIALTIES


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit counts per order in one aggregation; distinct specialties as bits of a mask."""
    lines = _table(spark, sf_dir, "lineitem")
    recent = F.col("l_linenumber") <= 3
    specialty = (F.col("l_suppkey") % 6).cast("int")
    bit = F.pow(F.lit(2), specialty).cast("int")
    seen = [specialty == i for i in range(4)]
    return lines.groupBy(F.col("l_orderkey")).agg(
        F.count(F.lit(1)).cast("int").alias(_VISIT_COLUMNS[0]),
        F.count_if(recent).cast("int").alias(_VISIT_COLUMNS[1]),
        F.bit_count(F.bit_or(bit)).alias(_VISIT_COLUMNS[2]),
        F.bit_count(F.bit_or(F.when(recent, bit).otherwise(0))).alias(_VISIT_COLUMNS[3]),
        *[F.count_if(s).cast("int").alias(name) for s, name in zip(seen, _VISIT_COLUMNS[4:])],
    )


def patient_level(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The wide patient table (or the named columns of it) over the supplied tables."""
    wanted = columns or list(SOURCE_COLUMNS)
    orders = _table(spark, sf_dir, "orders")
    known = _order_columns()
    customer = _customer_columns()
    burden = {"last_12months_chronic_count", "last_12months_diagnosis_count_ccw"}

    rows = orders
    if set(wanted) & (customer.keys() | burden | {"MaritalStatus"}):
        people = _table(spark, sf_dir, "customer")
        rows = rows.join(people, F.col("o_custkey") == F.col("c_custkey"))
        known |= customer
        known |= _burden_columns(known)
    if "MaritalStatus" in wanted:
        nation = _table(spark, sf_dir, "nation")
        region = _table(spark, sf_dir, "region")
        rows = rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            region, F.col("n_regionkey") == F.col("r_regionkey")
        )
        known["MaritalStatus"] = _null_every(19, F.col("r_name"))
    if set(wanted) & set(_VISIT_COLUMNS):
        rows = rows.join(_visits(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        known |= {c: F.coalesce(F.col(c), F.lit(0)) for c in _VISIT_COLUMNS}
    return rows.select([known[c].alias(c) for c in wanted])


# What a scored row needs besides its scores.
_SCORED_FLAGS = ["flag_glaucoma", "flag_diabetes", "flag_ckd", "flag_hf"]
_SCORED_META = [
    "patientID", "EncMonth", "Outcome", *_SCORED_FLAGS, "flag_glaucoma_diabetic", "flag_cancer",
    "last_12months_chronic_count", *AREA_GROUPS, *CATEGORIES,
]
_SCORED_SOURCES = [
    "patientID", "EncMonth", "Outcome", *[CONDITION_SOURCES[f] for f in _SCORED_FLAGS], *CANCER_SOURCES,
    "last_12months_chronic_count", *AREA_GROUPS, *CATEGORIES,
]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cohort rows with deterministic, heavily tied probabilities.

    ``y_prob`` has 1,000 distinct values, so ties straddle every tile boundary.
    """
    k = F.col("patientID")
    rows = build_features(patient_level(spark, sf_dir, _SCORED_SOURCES), _SCORED_META)
    return (
        rows.withColumn("y_true", F.col("Outcome"))
        .withColumn("y_prob", (k * 7919 % 1000) / 1000.0)
        .withColumn("p_logreg", F.col("y_prob"))
        .withColumn("p_rf", (k * 104729 % 1009) / 1009.0)
        .withColumn("p_gbt", (k * 1299709 % 499) / 499.0)
        .withColumn("y_pred", binarise("y_prob", 0.5))
        .withColumn("subgroup", exclusive_label())
        .drop("Outcome")
    )
