"""The two standing reports, as named frames: profile of a table, validation of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.operators import fairness, metrics, profile, ranking
from riskweave.session import materialise


def eda_report(patients: DataFrame) -> dict[str, DataFrame]:
    """Cohort, subgroups, deprivation, race, sex, missing values and months of a patient table."""
    return {
        "cohort and target": profile.cohort_summary(patients),
        "subgroups": profile.overlap_rates(patients),
        "deprivation quintile": profile.rate_by(patients, "ADINatRankQuintile", by_rate=False),
        "race/ethnicity": profile.rate_by(patients, "DerivedRaceEthnicity"),
        "sex": profile.rate_by(patients, "sex"),
        "missing values": profile.null_profile(patients),
        "months": profile.date_span(patients),
    }


def validation_report(scores: DataFrame) -> dict[str, DataFrame]:
    """Confusion tables, lift, capture, calibration gaps and calibration bins of scored rows.

    The scored rows are read once; lift, capture and calibration bins share one curve.
    """
    groups = ["subgroup", "DerivedRaceEthnicity", "ADINatRankQuintile"]
    scores = materialise(scores.select("patientID", "y_true", "y_prob", "y_pred", *groups), "scores")
    curve = ranking.keyed_curve(scores, "y_prob", "y_true")
    return {
        "confusion": metrics.confusion(scores),
        "confusion by subgroup": metrics.confusion(scores, ["subgroup"]),
        "decile lift": metrics.lift_table(scores, curve=curve),
        "top-decile capture": metrics.tile_capture(scores, curve=curve),
        "equity by race/ethnicity": fairness.calibration_gap(scores, "DerivedRaceEthnicity"),
        "equity by deprivation quintile": fairness.calibration_gap(scores, "ADINatRankQuintile"),
        "calibration": metrics.calibration_table(scores, curve=curve),
    }


def show(report: dict[str, DataFrame], rows: int = 50) -> None:
    """Print every frame of a report under its name; each is a handful of rows."""
    for name, frame in report.items():
        print(f"\n{name}")
        frame.show(rows, truncate=False)
