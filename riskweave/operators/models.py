"""Training, scoring, calibration and stacking.

Every fitted statistic (medians, levels, scales, weights, models) comes from the
training rows and lives in pipeline stages, so a holdout goes through the very same
steps and a model can be saved and loaded.

All fits of one kind are made together: the model of all rows, those of the folds and those of groups or
clusters share every scan (``lockstep``, ``newton``). Class weights are those of each fit's own rows, and of each bag in a forest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.functions.columns import logit
from riskweave.operators.encode import MAX_LEVELS, Encoding, fit_encoding
from riskweave.operators.features import CATEGORIES, ID, NUMERIC_FEATURES, TARGET
from riskweave.operators.fitted import FittedLinear, FittedTrees
from riskweave.operators.isotonic import isotonic_blocks
from riskweave.operators.lockstep import BoostSettings, ForestSettings, boost, fit_bins, fit_counts, grow_forests, pack
from riskweave.operators.metrics import evaluate
from riskweave.operators.newton import fit_logistics
from riskweave.operators.split import fold
from riskweave.session import materialise, ship

MODEL_NAMES = ("logreg", "rf", "gbt")
FITS_AT_ONCE = 8
LOWEST_GAIN = 0.01
LEAST_GROUP = 50  # training rows that a group needs for a model of its own
ALL = "all"


@dataclass(frozen=True)
class Settings:
    """Model sizes; the defaults are the fixed values of the full run."""

    lr_c: float = 0.1
    lr_iterations: int = 1000
    rf_trees: int = 300
    rf_depth: int = 8
    gbt_rounds: int = 500
    gbt_step: float = 0.05
    gbt_depth: int = 6
    gbt_leaves: int = 31
    gbt_columns: float = 0.8
    min_leaf: int = 20
    stack_c: float = 1.0
    stack_iterations: int = 500
    folds: int = 5
    seed: int = 42

    @property
    def boosting(self) -> BoostSettings:
        return BoostSettings(self.gbt_rounds, self.gbt_step, self.gbt_leaves, self.gbt_depth, self.min_leaf, self.gbt_columns, self.seed)

    @property
    def forest(self) -> ForestSettings:
        return ForestSettings(self.rf_trees, self.rf_depth, self.min_leaf, self.seed)


def concurrently(jobs: Sequence[Callable[[], Any]], at_once: int = FITS_AT_ONCE) -> list:
    """Results of independent fits, submitted together: each is a line of small jobs that leaves cores idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inherit(j)) for j in jobs]]


def fit_many(
    name: str, prepared: DataFrame, fits: Mapping[str, Column], settings: Settings, features: str = "features", widths: Mapping[str, int] | None = None
) -> dict[str, PipelineModel]:
    """One named model per fit, all in lock step; a fit is a condition on the rows it learns from.

    ``prepared`` are written rows with features and target. ``widths`` limits the named fits to leading features (boosting only).
    """
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown model: {name}")
    ship(prepared.sparkSession)
    keys, conditions = list(fits), list(fits.values())
    if name == "logreg":
        found = fit_logistics(prepared, TARGET, conditions, settings.lr_c, features, iterations=settings.lr_iterations)
        return {k: PipelineModel([FittedLinear.of(f).named(name, features)]) for k, f in zip(keys, found)}
    counts = fit_counts(prepared, TARGET, conditions)
    bins = fit_bins(prepared, ID, features)
    blocks = pack(prepared, ID, TARGET, conditions, bins, int(counts.sum()), features)
    width = len(bins.edges)
    if name == "rf":
        found = grow_forests(blocks, bins, counts, settings.forest)
    else:
        limits = [(widths or {}).get(k, width) for k in keys]
        found = boost(blocks, bins, counts, np.zeros(len(keys)), limits, settings.boosting)
    return {k: PipelineModel([FittedTrees.of(f, bins, width, name == "rf").named(name, features)]) for k, f in zip(keys, found)}


def fit_one(name: str, prepared: DataFrame, settings: Settings, features: str = "features") -> PipelineModel:
    """The named model of all rows."""
    return fit_many(name, prepared, {ALL: F.lit(True)}, settings, features)[ALL]


def add_probability(df: DataFrame, name: str, model: Transformer, out: str | None = None) -> DataFrame:
    """Transform and keep the probability of the positive class only."""
    scored = model.transform(df)
    return scored.withColumn(out or f"p_{name}", vector_to_array(F.col(f"prob_{name}"))[1]).drop(f"raw_{name}", f"prob_{name}", f"pred_{name}")


@dataclass
class Trained:
    """Encoding and named models fitted on one set of training rows."""

    encoding: Encoding
    prepare: PipelineModel
    models: dict[str, PipelineModel]
    settings: Settings
    n_train: int = 0
    #: Models of folds and groups: (fit, model name) to model.
    others: dict[tuple[str, str], PipelineModel] = field(default_factory=dict)

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.prepare.transform(df)

    def score(self, df: DataFrame, names: Sequence[str] | None = None, keep_features: bool = False) -> DataFrame:
        """Add ``p_<name>`` for each model; all in one pass over the rows."""
        out = self.prepared(df)
        for name in names or self.models:
            out = add_probability(out, name, self.models[name])
        return out if keep_features else out.drop("features")

    def pipeline(self, name: str, calibrator: IsotonicRegressionModel | None = None) -> PipelineModel:
        """Encoding, model and, if given, its calibrator as one unit for saving.

        The calibrator reads the positive class out of the probability vector, so the loaded
        unit gives ``p_calibrated`` from raw feature rows.
        """
        stages = [*self.prepare.stages, *self.models[name].stages]
        if calibrator is not None:
            applied = calibrator.copy().setFeaturesCol(f"prob_{name}").setFeatureIndex(1)
            stages.append(applied.setPredictionCol("p_calibrated"))
        return PipelineModel(stages)


def training_frame(prepared: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Only what fitting needs: id, target, features and the named extras."""
    return prepared.select(ID, F.col(TARGET).cast("int").alias(TARGET), "features", *keep)


def fold_fits(folds: int) -> dict[str, Column]:
    """Fits that leave one fold out each."""
    return {f"without fold {k}": fold(ID, folds) != k for k in range(folds)}


def group_fits(group: str, groups: Sequence) -> dict[str, Column]:
    return {f"{group} = {g}": F.col(group) == g for g in groups}


def train_models(
    train: DataFrame,
    settings: Settings = Settings(),
    names: Sequence[str] = MODEL_NAMES,
    numeric: Sequence[str] = tuple(NUMERIC_FEATURES),
    categories: Sequence[str] = tuple(CATEGORIES),
    sensitive_as_features: bool = False,
    keep: Sequence[str] = (),
    max_levels: int = MAX_LEVELS,
    also: Mapping[str, Column] | None = None,
    groups: Mapping[str, Column] | None = None,
) -> tuple[Trained, DataFrame]:
    """Fit the encoding and every named model on training rows.

    Returns the trained set and the training frame, written once and read by every fit.
    A category with more than ``max_levels`` levels is an error. ``also`` are further fits of every model, ``groups`` further
    fits of the boosted trees alone, made in lock step; groups with too few rows or one class are left out.
    """
    encoding = fit_encoding(train, numeric, categories, sensitive_as_features, max_levels)
    prepare = PipelineModel(encoding.stages())
    prepared = materialise(training_frame(prepare.transform(train), keep), "train")
    large, n = {}, 0
    if groups or also:
        wanted = {ALL: F.lit(True)} | dict(groups or {})
        counts = dict(zip(wanted, fit_counts(prepared, TARGET, list(wanted.values()))))
        n = int(counts.pop(ALL).sum())
        large = {k: wanted[k] for k, c in counts.items() if c.sum() >= LEAST_GROUP and c.min() > 0}
    else:
        n = prepared.count()
    fits = {ALL: F.lit(True)} | dict(also or {})
    jobs = [partial(fit_many, name, prepared, fits | (large if name == "gbt" else {}), settings) for name in names]
    found = dict(zip(names, concurrently(jobs)))
    models = {name: found[name].pop(ALL) for name in names}
    others = {(k, name): model for name in names for k, model in found[name].items()}
    return Trained(encoding, prepare, models, settings, n, others), prepared


# --- calibration -----------------------------------------------------------------


def fit_isotonic(df: DataFrame, score: str, label: str) -> IsotonicRegressionModel:
    """Increasing step fit of outcome on score.

    The fit is pooled by ranges of score in tasks (``isotonic_blocks``); the built-in model is made of the finished blocks,
    their ends as points, which it leaves as they are.
    """
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    points = isotonic_blocks(df, score, label).select(F.explode(ends).alias("score"), F.col("fitted").alias("outcome"), (F.col("n") / F.size(ends)).alias("rows"))
    return IsotonicRegression(featuresCol="score", labelCol="outcome", weightCol="rows", predictionCol="fitted").fit(points)


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, score: str, out: str) -> DataFrame:
    """Interpolated fit; scores outside the fitted range take the nearest end."""
    widened = df.withColumn("__s", F.col(score).cast("double"))
    applied = model.copy().setFeaturesCol("__s").setPredictionCol(out)
    return applied.transform(widened).drop("__s")


# --- stacking --------------------------------------------------------------------


def out_of_fold(
    prepared: DataFrame, settings: Settings, names: Sequence[str] = MODEL_NAMES, fitted: Mapping[tuple[str, str], PipelineModel] | None = None
) -> DataFrame:
    """``p_<name>`` of every training row from models that did not see it.

    ``fitted`` has the fold models if they were made before (``fold_fits``).
    """
    fits = fold_fits(settings.folds)
    if not fitted or any((k, name) not in fitted for k in fits for name in names):
        made = concurrently([partial(fit_many, name, prepared, fits, settings) for name in names])
        fitted = {(k, name): m for name, found in zip(names, made) for k, m in found.items()}
    out = None
    for number, k in enumerate(fits):
        part = prepared.filter(fold(ID, settings.folds) == number)
        for name in names:
            part = add_probability(part, name, fitted[k, name])
        out = part if out is None else out.unionByName(part)
    return materialise(out.drop("features"), "out-of-fold")


def stack_inputs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Probabilities and their logits, assembled by name so that both sides agree."""
    with_logits = df.withColumns({f"l_{n}": logit(f"p_{n}") for n in names})
    columns = [f"p_{n}" for n in names] + [f"l_{n}" for n in names]
    return VectorAssembler(inputCols=columns, outputCol="stacked").transform(with_logits).drop(*columns[len(names):])


def fit_stacker(oof: DataFrame, settings: Settings, names: Sequence[str] = MODEL_NAMES) -> PipelineModel:
    """A regression of the outcome on the stacked inputs, neither balanced nor standardised."""
    found = fit_logistics(
        stack_inputs(oof, names), TARGET, [F.lit(True)], settings.stack_c, "stacked", balance=False, standardise=False, iterations=settings.stack_iterations
    )
    return PipelineModel([FittedLinear.of(found[0]).named("stack", "stacked")])


def apply_stacker(df: DataFrame, stacker: PipelineModel, names: Sequence[str] = MODEL_NAMES) -> DataFrame:
    return add_probability(stack_inputs(df, names), "stack", stacker).drop("stacked")


# --- specialised models ----------------------------------------------------------


def specialised_scores(
    prepared_train: DataFrame,
    prepared_val: DataFrame,
    group: str,
    groups: Sequence,
    settings: Settings,
    min_train: int,
    min_val: int,
    name: str = "gbt",
    out: str = "p_special",
    fitted: Mapping[tuple[str, str], PipelineModel] | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """One model per group, scored on that group's validation rows and put back together.

    Returns the scored rows (None if no group was large enough) and a row per group
    with its sizes and status. Rows of groups without a model are not in the result:
    coverage is a left join away. ``fitted`` has the groups' models if they were made before (``group_fits``).
    """
    train_n, classes = _group_sizes(prepared_train, group, groups)
    val_n, _ = _group_sizes(prepared_val, group, groups)
    status, large = [], []
    for g in groups:
        n_tr, n_va = train_n.get(g, 0), val_n.get(g, 0)
        if n_tr < min_train or n_va < min_val:
            status.append((str(g), n_tr, n_va, "too small"))
        elif classes.get(g, 0) < 2:
            status.append((str(g), n_tr, n_va, "one class"))
        else:
            status.append((str(g), n_tr, n_va, "ok"))
            large.append(g)
    fits = group_fits(group, large)
    if large and (not fitted or any((k, name) not in fitted for k in fits)):
        fitted = {(k, name): model for k, model in fit_many(name, prepared_train, fits, settings).items()}
    scored = None
    for g, k in zip(large, fits):
        part = add_probability(prepared_val.filter(F.col(group) == g), name, fitted[k, name], out).drop("features")
        scored = part if scored is None else scored.unionByName(part)
    spark = prepared_train.sparkSession
    if scored is not None:
        scored = materialise(scored, "specialised")
    return scored, spark.createDataFrame(status, "`group` string, n_train long, n_val long, status string")


def _group_sizes(df: DataFrame, group: str, groups: Sequence) -> tuple[dict, dict]:
    """Rows and number of classes of the named groups (as many rows as names)."""
    sizes = df.filter(F.col(group).isin(list(groups))).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.max(TARGET) - F.min(TARGET) + 1).alias("c")
    )
    rows = sizes.collect()
    return {r[group]: r["n"] for r in rows}, {r[group]: r["c"] for r in rows}


def compare_general_special(general: DataFrame, special: DataFrame, key: str = "subgroup") -> DataFrame:
    """Left join of two records by group, with the AUROC gain and both verdict wordings."""
    g = general.select(key, F.round("auroc", 4).alias("general_auroc"), F.round("auprc", 4).alias("general_auprc"), F.col("auroc").alias("__g"))
    s = special.select(key, F.round("auroc", 4).alias("specialized_auroc"), F.round("auprc", 4).alias("specialized_auprc"), F.col("auroc").alias("__s"))
    joined = g.join(s, key, "left").withColumn("auroc_delta", F.round(F.col("__s") - F.col("__g"), 4))
    delta = F.col("__s") - F.col("__g")
    return joined.withColumns(
        {"recommendation": two_way_verdict(delta), "verdict": three_way_verdict(delta)}
    ).drop("__g", "__s")


def two_way_verdict(delta: Column) -> Column:
    return F.when(delta > LOWEST_GAIN, "specialize").when(delta.isNotNull(), "general_sufficient")


def three_way_verdict(delta: Column) -> Column:
    return (
        F.when(delta > LOWEST_GAIN, "specialize")
        .when(delta >= -LOWEST_GAIN, "general sufficient")
        .when(delta.isNotNull(), "general better")
    )


def holdout_report(
    scored: DataFrame, score: str, label: str = TARGET, tie: str = ID, subgroup: str = "subgroup", min_events: int = 2
) -> DataFrame:
    """Overall and per-subgroup rows, events, AUROC, AUPRC, Brier and mean score, in one grouped job."""
    slim = scored.select(tie, F.col(label).alias("__y"), F.col(score).alias("__p"), subgroup)
    long = slim.withColumn("part", F.explode(F.array(F.lit("Overall"), F.col(subgroup)))).drop(subgroup)
    record = evaluate(long, "__p", "__y", tie, ["part"], top=False)
    enough = (F.col("events") >= min_events) & (F.col("status") == "ok")
    return record.select(
        F.col("part").alias("subgroup"), "n", "events", F.col("prevalence").alias("event_rate"),
        F.when(enough, F.col("auroc")).alias("auroc"), F.when(enough, F.col("auprc")).alias("auprc"),
        "brier", "mean_score",
        F.when(enough, "ok").otherwise("too few events").alias("status"),
    )
