"""A whole training run: features, split, models, calibration, stacking, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from riskweave.functions.columns import first_match
from riskweave.operators import clusters as archetypes
from riskweave.operators import models as m
from riskweave.operators.features import AREA_GROUPS, ID, MONTH, TARGET, build_features
from riskweave.operators.groups import EXCLUSIVE_GROUPS, exclusive_label, rubric_conditions
from riskweave.operators.metrics import evaluate, score_models
from riskweave.operators.split import calibration_half, temporal_split
from riskweave.operators.thresholds import threshold_table
from riskweave.session import materialise
from riskweave.sources.tables import publish

SUBGROUPS_TRAINED = EXCLUSIVE_GROUPS[:3]
RUBRIC_TRAINED = ["CKD only", "HF only", "Cancer only", "Multi-condition"]


@dataclass
class Run:
    """What a training run leaves behind.

    ``train`` and ``val`` are tables in the shared folder; ``val`` has one probability
    column per model.
    """

    trained: m.Trained
    train: DataFrame
    val: DataFrame
    best: str
    calibrator: IsotonicRegressionModel
    auroc: float | None = None

    def scoring_unit(self) -> PipelineModel:
        """Encoding, best model and calibrator: what is saved, loaded and applied to a holdout or a stream."""
        return self.trained.pipeline(self.best, self.calibrator)

    @property
    def score_columns(self) -> dict[str, str]:
        return {name: f"p_{name}" for name in self.trained.models}


def _labelled(features: DataFrame) -> DataFrame:
    conditions = rubric_conditions()
    rubric = first_match([(conditions[g], g) for g in RUBRIC_TRAINED], "None")
    return features.withColumn("subgroup", exclusive_label()).withColumn("rubric", rubric)


def train_run(patients: DataFrame, settings: m.Settings = m.Settings(), sensitive_as_features: bool = False) -> Run:
    """Fit all models on the earlier months, score the later ones, calibrate the best on half of them."""
    # Sketches, medians, weights and both sides read these rows: keep them, read the source once.
    rows = materialise(_labelled(temporal_split(build_features(patients))), "features")
    train = rows.filter(F.col("split") == "train")
    keep = ["subgroup", "rubric", "split", *archetypes.PROFILE_COLUMNS]
    # Folds and groups are fitted in lock step with the models of all rows: they cost no jobs of their own.
    groups = m.group_fits("subgroup", SUBGROUPS_TRAINED) | m.group_fits("rubric", RUBRIC_TRAINED)
    trained, prepared = m.train_models(
        train, settings, sensitive_as_features=sensitive_as_features, keep=keep, also=m.fold_fits(settings.folds), groups=groups
    )
    val = trained.score(rows.filter(F.col("split") == "val"), keep_features=True)
    val = calibration_half(materialise(val.withColumn(TARGET, F.col(TARGET).cast("int")), "val"), written=True)
    records = score_models(val, {n: f"p_{n}" for n in trained.models}, TARGET)
    found = records.orderBy(F.desc("auroc"), "model").select("model", "auroc").first()
    best = found["model"]
    first_half = val.filter(F.col("half") == "calibrate")
    calibrator = m.fit_isotonic(first_half, f"p_{best}", TARGET)
    return Run(trained, prepared, val, best, calibrator, found["auroc"])


def calibrated(run: Run) -> DataFrame:
    """Validation rows not used for calibration, with the calibrated best score."""
    rest = run.val.filter(F.col("half") == "evaluate").drop("features")
    return m.apply_isotonic(rest, run.calibrator, f"p_{run.best}", "p_calibrated")


def stacked(run: Run) -> DataFrame:
    """Validation rows not used for calibration, with the calibrated stacked score."""
    names = list(run.trained.models)
    stacker = m.fit_stacker(m.out_of_fold(run.train, run.trained.settings, names, run.trained.others), run.trained.settings, names)
    scored = m.apply_stacker(run.val.drop("features"), stacker, names)
    fitted = m.fit_isotonic(scored.filter(F.col("half") == "calibrate"), "p_stack", TARGET)
    out = m.apply_isotonic(scored.filter(F.col("half") == "evaluate"), fitted, "p_stack", "p_stack_calibrated")
    return materialise(out, "stacked")


def comparison(run: Run, stacked_rows: DataFrame | None = None) -> DataFrame:
    """Records of the base models, the calibrated best and the calibrated stacker, best first.

    All are measured on the same rows: those that no calibration saw.
    """
    scored = m.apply_isotonic(stacked(run) if stacked_rows is None else stacked_rows, run.calibrator, f"p_{run.best}", "p_calibrated")
    columns = run.score_columns | {
        f"{run.best}_calibrated": "p_calibrated",
        "stacker_calibrated": "p_stack_calibrated",
    }
    return score_models(scored, columns, TARGET).orderBy(F.desc("auroc"), "model")


def general_vs_specialised(run: Run, group: str = "subgroup", groups: list[str] | None = None, min_val: int = 20) -> DataFrame:
    """Per group: records of the general and of the group's own model, gain and verdicts."""

    groups = groups or SUBGROUPS_TRAINED
    scored, status = m.specialised_scores(run.train, run.val, group, groups, run.trained.settings, m.LEAST_GROUP, min_val, fitted=run.trained.others)
    general = evaluate(run.val.filter(F.col(group).isin(groups)), f"p_{run.best}", TARGET, ID, [group])
    general = general.withColumnRenamed(group, "subgroup")
    if scored is None:
        special = general.limit(0)
    else:
        special = evaluate(scored, "p_special", TARGET, ID, [group]).withColumnRenamed(group, "subgroup")
    compared = m.compare_general_special(general, special)
    sizes = status.withColumnRenamed("group", "subgroup")
    return sizes.join(compared, "subgroup", "left")


@dataclass
class ClusterRun:
    fitted: archetypes.Archetypes
    train: DataFrame
    val: DataFrame


def cluster_run(run: Run, restarts: int = archetypes.RESTARTS) -> ClusterRun:
    """Cluster training rows; assign both sides to the nearest centre."""
    fitted = archetypes.fit_archetypes(run.train, restarts=restarts)
    return ClusterRun(
        fitted, materialise(fitted.assign(run.train), "clusters-train"), materialise(fitted.assign(run.val), "clusters-val")
    )


def cluster_profile(run: Run, found: ClusterRun) -> DataFrame:
    """Means of the profile columns per cluster, over the training rows as the models see them: imputed."""
    medians = {c: float(v) for c, v in run.trained.encoding.medians.items() if c in archetypes.PROFILE_COLUMNS}
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))).alias(c) for c in archetypes.PROFILE_COLUMNS]
    return archetypes.cluster_means(found.train.select("cluster", *columns))


def scores_of(run: Run, stacked_rows: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """The eight-column score contract of a trained run.

    Scores are those of the calibrated stacker, on the validation rows that no calibration
    saw. ``threshold`` is the operating point; unset, it is the recommended one of these scores.
    """
    scored = stacked(run) if stacked_rows is None else stacked_rows
    rows = scored.withColumn("y_true", F.col(TARGET).cast("int")).withColumn("y_prob", F.col("p_stack_calibrated"))
    if threshold is None:
        recommended = threshold_table(rows.select("y_true", "y_prob")).filter(F.col("kind") == "recommended")
        cut = recommended.select("threshold").scalar()
    else:
        cut = F.lit(float(threshold))
    flagged = (F.col("y_prob") >= cut).cast("int").alias("y_pred")
    return rows.select(ID, "y_true", "y_prob", flagged, "subgroup", "DerivedRaceEthnicity", *AREA_GROUPS)


def publish_scores(run: Run, view: str = "scores") -> DataFrame:
    """The trained run's scores as a table that SQL reads under ``view``."""
    return publish(materialise(scores_of(run), "scores"), view)


def cluster_comparison(run: Run, found: ClusterRun) -> DataFrame:
    """General model, clusters as features, and one model per cluster, on the validation rows.

    The per-cluster record covers only rows of clusters large enough to train on;
    ``covered`` is their share.
    """
    settings = run.trained.settings
    k = found.fitted.k
    # One lock step for all: the clusters' own models know only the features without the indicators.
    known = m.group_fits("cluster", list(range(k)))
    width = len(run.trained.encoding.names)
    rows = materialise(archetypes.with_indicators(found.train, k), "clusters-wide")
    counts = dict(zip(known, m.fit_counts(rows, TARGET, list(known.values()))))
    known = {name: c for name, c in known.items() if counts[name].sum() >= m.LEAST_GROUP and counts[name].min() > 0}
    fitted = m.fit_many("gbt", rows, {m.ALL: F.lit(True)} | known, settings, widths=dict.fromkeys(known, width))
    with_aug = m.add_probability(archetypes.with_indicators(found.val, k), "gbt", fitted.pop(m.ALL), "p_augmented")
    wide = with_aug.select(ID, TARGET, F.col(f"p_{run.best}").alias("general"), F.col("p_augmented").alias("cluster_feature"))
    own = {(name, "gbt"): model for name, model in fitted.items()}
    per_cluster, _ = m.specialised_scores(found.train, found.val, "cluster", list(range(k)), settings, m.LEAST_GROUP, 10, fitted=own)
    pairs = [F.struct(F.lit(c).alias("model"), F.col(c).alias("score")) for c in ("general", "cluster_feature")]
    long = wide.select(ID, TARGET, F.explode(F.array(*pairs)).alias("s")).select(ID, TARGET, "s.*")
    if per_cluster is not None:
        part = per_cluster.select(ID, TARGET, F.lit("per_cluster").alias("model"), F.col("p_special").alias("score"))
        long = long.unionByName(part)
    long = materialise(long, "cluster-scores")
    record = evaluate(long, "score", TARGET, ID, ["model"])
    general = record.filter(F.col("model") == "general")
    rows, base = general.select("n").scalar(), general.select("auroc").scalar()
    return record.select(
        "model", "n", "auroc", "auprc", "brier", "lift_top_decile",
        (F.col("n") / rows).alias("covered"), (F.col("auroc") - base).alias("auroc_delta"),
        F.when(F.col("model") == "cluster_feature", archetypes.cluster_verdict(F.col("auroc") - base)).alias("verdict"),
    )


def score_rows(unit: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows of the feature view through a (loaded) scoring unit; a table or a stream."""
    made = [c for c in ("features", "scaled") if c not in rows.columns]
    scored = unit.transform(rows)
    helpers = [c for c in scored.columns if c.startswith(("raw_", "prob_", "pred_"))]
    return scored.drop(*made, *helpers)


def score_holdout(run: Run, holdout: DataFrame) -> DataFrame:
    """Holdout rows through the training encoding, the best model and its calibrator, all one unit."""
    return score_rows(run.scoring_unit(), build_features(holdout).withColumn("subgroup", exclusive_label()))
