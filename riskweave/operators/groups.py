"""Cohort memberships: exclusive labels, overlapping groups, condition groups.

Overlapping memberships are built as one array per row and exploded, so a report
over many groups reads its input once, however many groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions.columns import first_match

# Names of the groups.
GLAUCOMA_ONLY, DIABETIC_ONLY, BOTH_CONDITIONS, NEITHER = "Glaucoma only", "Diabetic only", "Glaucoma+Diabetic", "Neither"
EXCLUSIVE_GROUPS = [GLAUCOMA_ONLY, DIABETIC_ONLY, BOTH_CONDITIONS, NEITHER]
RUBRIC_GROUPS = ["CKD only", "HF only", "Cancer only", "Multi-condition", "CKD (any)", "HF (any)", "Cancer (any)"]


def is_set(name: str) -> Column:
    return F.coalesce(F.col(name) == 1, F.lit(False))


def exclusive_label(a: str = "flag_glaucoma", b: str = "flag_diabetes") -> Column:
    """Exactly one label per row: both, A only, B only, neither."""
    return first_match(
        [
            (is_set(a) & is_set(b), BOTH_CONDITIONS),
            (is_set(a), GLAUCOMA_ONLY),
            (is_set(b), DIABETIC_ONLY),
        ],
        NEITHER,
    )


def overlap_conditions() -> dict[str, Column]:
    """Overlapping groups of the raw patient table; a row may be in several."""
    g, d = is_set("cms_ccw_glaucoma_36"), is_set("cms_ccw_diabetes_36")
    return {
        "Glaucoma": g,
        "Diabetic": d,
        BOTH_CONDITIONS: g & d,
        "CKD": is_set("cms_ccw_chronic_kidney_disease_36"),
        "Heart Failure": is_set("cms_ccw_heart_failure_36"),
    }


def rubric_conditions(ckd: str = "flag_ckd", hf: str = "flag_hf", cancer: str = "flag_cancer") -> dict[str, Column]:
    """Three exclusive condition groups, two-or-more, and three inclusive ones."""
    flags = [is_set(ckd), is_set(hf), is_set(cancer)]
    count = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    names = ["CKD", "HF", "Cancer"]
    groups = {f"{n} only": f & (count == 1) for n, f in zip(names, flags)}
    groups["Multi-condition"] = count >= 2
    groups |= {f"{n} (any)": f for n, f in zip(names, flags)}
    return groups


def explode_memberships(df: DataFrame, conditions: dict[str, Column], out: str = "subgroup") -> DataFrame:
    """One output row per (row, group it belongs to). Rows in no group leave."""
    member = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))
    return df.withColumn(out, F.explode(member))


def explode_dimensions(df: DataFrame, dims: dict[str, str], dimension: str = "dimension", group: str = "group") -> DataFrame:
    """One output row per (row, audit dimension) whose value is known.

    ``dims`` maps a column to its printed name; columns the frame lacks are left out.
    """
    have = set(df.columns)
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(label).alias(dimension), F.col(c).cast("string").alias(group)))
        for c, label in dims.items()
        if c in have
    ]
    exploded = df.withColumn("__dim", F.explode(F.array_compact(F.array(*pairs))))
    keep = [c for c in df.columns if c not in (dimension, group)]
    return exploded.select(*keep, F.col(f"__dim.{dimension}"), F.col(f"__dim.{group}"))
