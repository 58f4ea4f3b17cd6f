"""The feature view: one row per patient snapshot, cohort members only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskweave.functions.columns import any_flag, both, flag, guarded_ratio, log1p

_INT, _DBL, _STR = T.IntegerType(), T.DoubleType(), T.StringType()

ID, MONTH, TARGET = "patientID", "EncMonth", "Outcome"

# Names of the input table's columns.
CONDITION_SOURCES = {
    "flag_glaucoma": "cms_ccw_glaucoma_36",
    "flag_diabetes": "cms_ccw_diabetes_36",
    "flag_blindness": "cms_ccw_sensory_blindness_and_visual_impairment_36",
    "flag_cataract": "cms_ccw_cataract_36",
    "flag_hypertension": "cms_ccw_hypertension_36",
    "flag_obesity": "cms_ccw_obesity_36",
    "flag_ckd": "cms_ccw_chronic_kidney_disease_36",
    "flag_hf": "cms_ccw_heart_failure_36",
    "flag_ihd": "cms_ccw_ischemic_heart_disease_36",
    "flag_afib": "cms_ccw_atrial_fibrillation_36",
    "flag_depression": "cms_ccw_depression_36",
    "flag_anxiety": "cms_ccw_anxiety_disorders_36",
    "flag_tobacco": "cms_ccw_tobacco_use_36",
}
CANCER_SOURCES = ["cms_ccw_lung_cancer_36", "cms_ccw_colorectal_cancer_36", "cms_ccw_female_male_breast_cancer_36"]
BURDEN = ["last_12months_diagnosis_count_ccw", "last_12months_chronic_count"]
DEPRIVATION = ["ADINatrank", "ADIStaterank", "CAHPIPercentile", "straight_line_distance_miles"]
AREA_GROUPS = ["ADINatRankQuintile", "CAHPIQuartile"]
VISITS = [
    "last_12months_officevisit_count",
    "last_6months_officevisit_count",
    "last_12months_officevisit_distinct_specialty",
    "last_6months_officevisit_distinct_specialty",
]
SPECIALTIES = ["Specialty_internal_medicine", "Specialty_family_practice", "Specialty_nephrology", "Specialty_cardiology"]
CATEGORIES = ["DerivedRaceEthnicity", "MaritalStatus", "sex"]

SOURCE_COLUMNS: dict[str, T.DataType] = {
    ID: T.LongType(),
    MONTH: _INT,
    TARGET: _INT,
    **dict.fromkeys(CONDITION_SOURCES.values(), _INT),
    **dict.fromkeys(CANCER_SOURCES, _INT),
    **dict.fromkeys(BURDEN, _INT),
    **dict.fromkeys(DEPRIVATION, _DBL),
    **dict.fromkeys(AREA_GROUPS, _INT),
    **dict.fromkeys(VISITS + SPECIALTIES, _INT),
    **dict.fromkeys(CATEGORIES, _STR),
}


def _derived() -> dict[str, Column]:
    """Output column -> expression, in view order."""
    source = CONDITION_SOURCES
    view: dict[str, Column] = {c: F.col(c) for c in (ID, MONTH, TARGET)}
    view["flag_glaucoma"] = F.col(source["flag_glaucoma"])
    view["flag_diabetes"] = F.col(source["flag_diabetes"])
    view["flag_glaucoma_diabetic"] = both(source["flag_glaucoma"], source["flag_diabetes"])
    for name, column in source.items():
        view.setdefault(name, F.col(column))
    view["flag_cancer"] = any_flag(*CANCER_SOURCES)
    view |= {c: F.col(c) for c in BURDEN + DEPRIVATION}
    view["distance_log"] = log1p("straight_line_distance_miles")
    # Cut-offs of the deprivation, distance and breadth flags.
    view["high_deprivation"] = flag(F.col("ADINatrank") >= 80)
    view["low_cahpi"] = flag(F.col("CAHPIPercentile") <= 25)
    view["far_from_care"] = flag(F.col("straight_line_distance_miles") > 10)
    view |= {c: F.col(c) for c in AREA_GROUPS + VISITS}
    view["op_recency_ratio"] = guarded_ratio(VISITS[1], VISITS[0])
    view["high_specialty_breadth"] = flag(F.col(VISITS[2]) >= 3)
    view |= {c: F.col(c) for c in SPECIALTIES}
    view["cardio_visit_ratio"] = guarded_ratio("Specialty_cardiology", VISITS[0])
    view |= {c: F.col(c) for c in CATEGORIES}
    return view


FEATURE_VIEW_COLUMNS = [
    ID, MONTH, TARGET,
    "flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic",
    *[c for c in CONDITION_SOURCES if c not in ("flag_glaucoma", "flag_diabetes")], "flag_cancer",
    *BURDEN, *DEPRIVATION, "distance_log", "high_deprivation", "low_cahpi", "far_from_care", *AREA_GROUPS,
    *VISITS, "op_recency_ratio", "high_specialty_breadth",
    *SPECIALTIES, "cardio_visit_ratio",
    *CATEGORIES,
]

# Kept beside the features for grouping and auditing, never used as features.
META_COLUMNS = [
    ID, MONTH, TARGET, "flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic",
    *AREA_GROUPS, *CATEGORIES,
]
NUMERIC_FEATURES = [c for c in FEATURE_VIEW_COLUMNS if c not in META_COLUMNS]


def in_cohort() -> Column:
    """Rows with a known outcome and at least one of the two conditions."""
    member = (F.col(CONDITION_SOURCES["flag_glaucoma"]) == 1) | (F.col(CONDITION_SOURCES["flag_diabetes"]) == 1)
    return F.col(TARGET).isNotNull() & member


def build_features(patients: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The feature view over a wide patient table; train and holdout both go through here.

    ``columns`` narrows the view so that only the inputs it needs are read.
    """
    view = _derived()
    wanted = columns or FEATURE_VIEW_COLUMNS
    return patients.filter(in_cohort()).select([view[c].alias(c) for c in wanted])
