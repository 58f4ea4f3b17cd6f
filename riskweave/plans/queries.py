"""Registered queries: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskweave.functions import text
from riskweave.functions.columns import binarise, logit, risk_level
from riskweave.operators import (
    attribution,
    clusters,
    encode,
    export,
    fairness,
    insights,
    metrics,
    models,
    profile,
    ranking,
    split,
    thresholds,
)
from riskweave.operators.features import NUMERIC_FEATURES, build_features
from riskweave.operators.worklist import monthly_worklist
from riskweave.plans import fixed_models, training
from riskweave.session import fresh_path, materialise
from riskweave.sources import documents
from riskweave.sources.adapter import patient_level, scores
from riskweave.sources.tables import align_columns, describe, missing_columns, publish, read_table
from riskweave.streaming.scoring import audit_report, audit_sums, write_batches

Query = Callable[[SparkSession, str], DataFrame]
MODEL_SCORES = {"logreg": "p_logreg", "rf": "p_rf", "gbt": "p_gbt"}
_RAW_FLAGS = [
    "Outcome", "cms_ccw_glaucoma_36", "cms_ccw_diabetes_36", "cms_ccw_chronic_kidney_disease_36", "cms_ccw_heart_failure_36",
]
_COHORT = ["patientID", "EncMonth", "Outcome", "cms_ccw_glaucoma_36", "cms_ccw_diabetes_36"]


# Digits compared: means of many rows agree to ten; logarithms of single rows, which two
# math libraries may round differently in the last bit, are compared to six.
MEAN_DIGITS, LOG_DIGITS = 10, 6


def rounded(df: DataFrame, digits: int = MEAN_DIGITS) -> DataFrame:
    """Doubles to fixed digits, so that the order of a floating sum does not show."""
    return df.select(
        [F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema]
    )


def _patients(columns: list[str] | None = None):
    return lambda spark, d: patient_level(spark, d, columns)


def _on(source, operator, digits: int = MEAN_DIGITS) -> Query:
    return lambda spark, d: rounded(operator(source(spark, d)), digits)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return build_features(patient_level(spark, d))


def _cohort(spark: SparkSession, d: str) -> DataFrame:
    keep = ["patientID", "EncMonth", "Outcome", "flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic"]
    return build_features(patient_level(spark, d, _COHORT), keep)


def _record(df: DataFrame) -> DataFrame:
    return metrics.evaluate(df).drop("status")


def _part(*columns: str):
    return lambda df: metrics.evaluate(df, top=any("top" in c for c in columns)).select("n", "events", *columns)


def profile_queries() -> dict[str, Query]:
    dims = ["ADINatRankQuintile", "DerivedRaceEthnicity", "sex"]
    return {
        "cohort_summary": _on(_patients(["Outcome"]), profile.cohort_summary),
        "overlap_groups": _on(_patients(_RAW_FLAGS), profile.overlap_rates),
        "exclusive_groups": _on(
            scores,
            lambda df: df.groupBy("subgroup").agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("events"), F.avg("y_true").alias("rate")
            ),
        ),
        "rate_by_quintile": _on(_patients(["Outcome", dims[0]]), lambda df: profile.rate_by(df, dims[0], by_rate=False)),
        "rate_by_race": _on(_patients(["Outcome", dims[1]]), lambda df: profile.rate_by(df, dims[1])),
        "rate_by_sex": _on(_patients(["Outcome", dims[2]]), lambda df: profile.rate_by(df, dims[2])),
        "profile_by_dims": _on(_patients(["Outcome", *dims]), lambda df: profile.rate_by_dimensions(df, dims)),
        "null_profile": _on(_patients(list(profile.NULL_PROFILE.values())), profile.null_profile),
        "date_span": _on(_cohort, profile.date_span),
        "correlations": _on(_features, profile.correlations),
        "flag_totals": _on(_cohort, profile.flag_totals),
        "feature_view": _on(_features, lambda df: df, LOG_DIGITS),
        "temporal_split": _on(_cohort, lambda df: split.temporal_split(df).select("patientID", "EncMonth", "split")),
        "split_summary": _on(_cohort, lambda df: split.split_summary(split.temporal_split(df))),
    }


def score_queries() -> dict[str, Query]:
    return {
        "confusion_overall": _on(scores, metrics.confusion),
        "confusion_by_group": _on(scores, lambda df: metrics.confusion(df, ["subgroup"])),
        "decile_lift": _on(scores, metrics.lift_table),
        "decile_capture": _on(scores, metrics.tile_capture),
        "calibration_bins": _on(scores, metrics.calibration_table),
        "global_ntile": _on(
            scores,
            lambda df: ranking.global_ntile(df.select("patientID", "y_prob"), 7, "y_prob", "patientID"),
        ),
        "global_row_number": _on(
            scores,
            lambda df: ranking.global_row_number(
                df.select("subgroup", "patientID", "y_prob"), "y_prob", "patientID", ["subgroup"], total="n"
            ),
        ),
        "auroc": _on(scores, _part("auroc")),
        "auprc": _on(scores, _part("auprc")),
        "brier": _on(scores, _part("brier")),
        "mace": _on(scores, _part("mace")),
        "topk_lift": _on(scores, _part("lift_top_decile", "capture_top_decile")),
        "metrics_full": _on(scores, _record),
        "quick_record": _on(scores, metrics.quick_record),
        "group_metrics": _on(scores, fairness.subgroup_metrics),
        "rubric_metrics": _on(scores, fairness.rubric_metrics),
        "model_records": _on(scores, lambda df: metrics.compare_models(metrics.score_models(df, MODEL_SCORES))),
        "best_model": _on(
            scores, lambda df: metrics.best_model(metrics.score_models(df, MODEL_SCORES)).select("model", "auroc")
        ),
        "equity_table": _on(scores, fairness.equity_table),
        "equity_gap": _on(scores, lambda df: fairness.equity_gaps(fairness.equity_table(df))),
        "calibration_gap_race": _on(scores, lambda df: fairness.calibration_gap(df, "DerivedRaceEthnicity")),
        "calibration_gap_adi": _on(scores, lambda df: fairness.calibration_gap(df, "ADINatRankQuintile")),
        "pr_curve": _on(scores, thresholds.pr_curve),
        "threshold_table": _on(scores, thresholds.threshold_table),
    }


def _train_side(spark: SparkSession, d: str) -> DataFrame:
    """Training rows as a table, as a training run keeps them: several passes follow."""
    return materialise(split.temporal_split(_features(spark, d)).filter(F.col("split") == "train"), "train")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    """Imputed numerics and one-hot categories of every row, fitted on the training months."""
    encoding = encode.fit_encoding(
        _train_side(spark, d), ["ADINatrank", "CAHPIPercentile", "straight_line_distance_miles"], sensitive_as_features=True
    )
    expand = encoding.stages()[0]
    return expand.transform(_features(spark, d)).select("patientID", *[F.col(f"x_{n}").alias(n) for n in encoding.names])


def _class_weights(df: DataFrame) -> DataFrame:
    weighted = encode.balance_weights(df)
    return weighted.groupBy("Outcome").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """A table that lacks a training column and has one too many."""
    return align_columns(patient_level(spark, d, ["patientID", "EncMonth", "sex"]), ["patientID", "EncMonth", "Specialty_cardiology"])


def _isotonic(df: DataFrame) -> DataFrame:
    halves = split.calibration_half(materialise(df.select("patientID", "EncMonth", "y_true", "y_prob"), "scores"))
    fitted = models.fit_isotonic(halves.filter(F.col("half") == "calibrate"), "y_prob", "y_true")
    rest = halves.filter(F.col("half") == "evaluate")
    return models.apply_isotonic(rest, fitted, "y_prob", "p_cal").select("patientID", "y_prob", "p_cal")


def _cohort_models(df: DataFrame) -> DataFrame:
    flat = export.cohort_models(df, MODEL_SCORES)
    points = [F.element_at("trend", i + 1).alias(f"t{i + 1}") for i in range(6)]
    return flat.select("subgroup", "model", "risk_score", "risk_level", *points)


def _document(df: DataFrame) -> DataFrame:
    """The nested document of the deterministic scores, through JSON text and back."""
    records = export.cohort_records(df, MODEL_SCORES)
    built = export.assemble_document(records, list(MODEL_SCORES), "rf", generated_at="2024-01-01")
    return documents.parse_json(documents.as_json(built))


def _flat_document(df: DataFrame) -> DataFrame:
    flat = documents.flatten(_document(df))
    return flat.select(
        "id", "name", "category", "population", "disease_burden", "model", "is_default", "risk_score", "risk_level",
        F.element_at("trend", -1).alias("latest"), F.size("trend").alias("points"),
    )


def _deep_cohorts(df: DataFrame) -> DataFrame:
    return insights.with_depth(documents.default_cohorts(_document(df)))


def _insight_rows(df: DataFrame) -> DataFrame:
    records = insights.validate_insights(insights.insights(_deep_cohorts(df)))
    return records.select(
        "id", "source", "summary", F.array_join("riskDrivers", "; ").alias("drivers"), "trendInterpretation",
        F.size("caveats").alias("caveats"), "status",
    )


def _depth_rows(df: DataFrame) -> DataFrame:
    keep = ["id", "population", "disease_burden", "depth_basis", "normalized_disease_burden"]
    return insights.ranked_cohorts(_deep_cohorts(df)).select(*keep)


def matrix_queries() -> dict[str, Query]:
    return {
        "medians": lambda spark, d: rounded(encode.column_medians(_train_side(spark, d), NUMERIC_FEATURES)),
        "encoded_features": lambda spark, d: rounded(_encoded(spark, d)),
        "class_weights": _on(_cohort, _class_weights),
        "aligned_columns": _aligned,
        "calibration_half": _on(
            scores, lambda df: split.calibration_half(df.select("patientID", "EncMonth")).select("patientID", "EncMonth", "half")
        ),
        "isotonic_scores": _on(scores, _isotonic),
        "logit": _on(
            scores,
            lambda df: df.select("patientID", logit("p_rf").alias("l_rf"), binarise("p_rf", 0.25).alias("over")),
            LOG_DIGITS,
        ),
        "risk_level": _on(
            scores,
            lambda df: df.groupBy("subgroup", risk_level("p_gbt").alias("level")).agg(F.count(F.lit(1)).alias("n")),
        ),
    }


def export_queries() -> dict[str, Query]:
    return {
        "monthly_trend": _on(
            scores,
            lambda df: export.monthly_means(df, MODEL_SCORES).withColumn("mean_score", F.col("score_sum") / F.col("n")).drop("score_sum"),
        ),
        "disease_burden": _on(scores, export.disease_burden),
        "cohort_models": _on(scores, _cohort_models),
        "document_flat": _on(scores, _flat_document),
        "normalised_burden": _on(scores, _depth_rows),
        "cohort_panel": _on(scores, lambda df: insights.panel(_deep_cohorts(df))),
        "insights": _on(scores, _insight_rows),
        "cohort_lookup": _on(
            scores,
            lambda df: documents.select_cohort(documents.default_cohorts(_document(df)), "cohort_diabetic").select(
                "id", "name", "population", "model.risk_score"
            ),
        ),
    }


_runs: dict[tuple[str, str, str], Any] = {}


def _shared(spark: SparkSession, d: str, what: str, make: Callable[[], Any]) -> Any:
    """Made once per session and folder, shared by the queries below."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _runs:
        _runs[key] = make()
    return _runs[key]


def _run(spark: SparkSession, d: str) -> training.Run:
    """One training run over the whole table, in the library's full sizes."""
    return _shared(spark, d, "run", lambda: training.train_run(patient_level(spark, d)))


def _clusters(spark: SparkSession, d: str) -> training.ClusterRun:
    return _shared(spark, d, "clusters", lambda: training.cluster_run(_run(spark, d)))


def _stacked(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d, "stacked", lambda: training.stacked(_run(spark, d)))


def _trained_scores(spark: SparkSession, d: str) -> DataFrame:
    made = lambda: materialise(training.scores_of(_run(spark, d), _stacked(spark, d)), "scores")
    return publish(_shared(spark, d, "scores", made), "scores")


def _importance(run: training.Run, spark: SparkSession) -> DataFrame:
    return attribution.importances(spark, run.trained.models, run.trained.encoding.names)


def _attribution(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d)
    parts = [
        attribution.attribution(run.val, pipeline, run.trained.encoding.names).withColumn("model", F.lit(name))
        for name, pipeline in run.trained.models.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _trained_document(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d)
    best = attribution.top_features(_importance(run, spark))
    records = export.cohort_records(run.val, run.score_columns, best)
    return export.assemble_document(records, list(run.score_columns), run.best, generated_at="2024-01-01", validation_auroc=run.auroc)


def _holdout(spark: SparkSession, d: str) -> DataFrame:
    """The supplied tables have no holdout: the whole table goes through the scoring unit."""
    return training.score_holdout(_run(spark, d), patient_level(spark, d))


def model_queries() -> dict[str, Query]:
    """Fitted models have no SQL equal; the driver checks rows only."""
    return {
        "model_compare": lambda spark, d: training.comparison(_run(spark, d), _stacked(spark, d)),
        "calibrated_scores": lambda spark, d: training.calibrated(_run(spark, d)).select("patientID", "Outcome", "p_calibrated"),
        "specialised_vs_general": lambda spark, d: training.general_vs_specialised(_run(spark, d)),
        "rubric_specialised": lambda spark, d: training.general_vs_specialised(_run(spark, d), "rubric", training.RUBRIC_TRAINED),
        "cluster_sizes": lambda spark, d: clusters.cluster_sizes(
            _clusters(spark, d).train.select("cluster", "split", "Outcome").unionByName(
                _clusters(spark, d).val.select("cluster", "split", "Outcome")
            )
        ),
        "cluster_profile": lambda spark, d: training.cluster_profile(_run(spark, d), _clusters(spark, d)),
        "cluster_comparison": lambda spark, d: training.cluster_comparison(_run(spark, d), _clusters(spark, d)),
        "importance": lambda spark, d: attribution.label_features(_importance(_run(spark, d), spark)),
        "attribution": _attribution,
        "holdout_scores": lambda spark, d: models.holdout_report(_holdout(spark, d), "p_calibrated"),
        "export_document": lambda spark, d: documents.as_json(_trained_document(spark, d)),
        "trained_scores": _trained_scores,
        "trained_equity": lambda spark, d: fairness.equity_table(_trained_scores(spark, d)),
        "trained_thresholds": lambda spark, d: thresholds.threshold_table(_trained_scores(spark, d)),
        "trained_insights": lambda spark, d: insights.insights(documents.default_cohorts(_trained_document(spark, d))),
    }


# --- the parts of the model plans that need no fitted model, on fixed columns ---------------


def _wide_ranks(df: DataFrame) -> DataFrame:
    """Ranks by a score that doubles cannot tell apart."""
    wide = df.select("patientID", (F.lit(2**60) + F.col("patientID") % 5000).alias("score"))
    return ranking.global_row_number(wide, "score", "patientID")


def _verdicts(df: DataFrame) -> DataFrame:
    """The forest's column as the general model, the boosted one as the specialised models."""
    general, special = (metrics.evaluate(df, c, by=["subgroup"], top=False) for c in ("p_rf", "p_gbt"))
    compared = models.compare_general_special(general, special)
    return compared.withColumn("cluster_verdict", clusters.cluster_verdict(F.col("auroc_delta")))


def _fixed_clusters(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster", (F.col("patientID") % 4).cast("int"))


def _coverage(df: DataFrame) -> DataFrame:
    """Scores of two of four clusters, put back together beside all rows."""
    rows = _fixed_clusters(df).select("patientID", "cluster", "p_rf")
    parts = [rows.filter(F.col("cluster") == c).select("patientID", F.col("p_rf").alias("p_special")) for c in (0, 2)]
    whole = rows.join(parts[0].unionByName(parts[1]), "patientID", "left")
    return whole.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count("p_special").alias("covered"), F.avg("p_special").alias("mean"))


_WEIGHED = ("flag_ckd", "flag_hf", "flag_cancer", "N/A")


def _fixed_importance(df: DataFrame) -> DataFrame:
    """(model, feature, importance) from means of the deterministic scores over flagged rows."""
    flags = df.withColumn("N/A", F.lit(1))
    sums = flags.agg(*[F.avg(F.col(c) * F.col(f)).alias(f"{m}|{f}") for m, c in MODEL_SCORES.items() for f in _WEIGHED])
    long = sums.unpivot([], sums.columns, "key", "importance")
    return long.select(F.split("key", "[|]")[0].alias("model"), F.split("key", "[|]")[1].alias("feature"), "importance")


def _top_rows(df: DataFrame) -> DataFrame:
    best = attribution.top_features(_fixed_importance(df))
    return best.select("model", F.posexplode("top_features").alias("place", "f")).select("model", "place", "f.feature", "f.importance")


def _drivers(df: DataFrame) -> DataFrame:
    """Insight drivers of cohorts that have features, a placeholder among them."""
    records = export.cohort_records(df, MODEL_SCORES, attribution.top_features(_fixed_importance(df)))
    document = export.assemble_document(records, list(MODEL_SCORES), "rf", generated_at="2024-01-01")
    return insights.insights(documents.default_cohorts(document)).select("id", F.array_join("riskDrivers", "; ").alias("drivers"))


def _fixed_slopes(df: DataFrame) -> DataFrame:
    rows = df.select(F.array(*[F.col(c).cast("double") for c in ("flag_ckd", "flag_hf", "last_12months_chronic_count")]).alias("features"))
    slopes = [(0, "flag_ckd", 0.5, 0.25), (1, "flag_hf", -2.0, 0.125), (2, "last_12months_chronic_count", 0.25, 2.0)]
    dim = df.sparkSession.createDataFrame(slopes, "pos int, feature string, slope double, mean double")
    return attribution.linear_attribution(rows, dim)


def fixed_queries() -> dict[str, Query]:
    return {
        "global_row_number_wide": _on(scores, _wide_ranks),
        "specialised_verdicts": _on(scores, _verdicts),
        "cluster_sizes_fixed": _on(
            _cohort, lambda df: clusters.cluster_sizes(_fixed_clusters(split.temporal_split(df)).select("cluster", "split", "Outcome"))
        ),
        "cluster_means_fixed": _on(_features, lambda df: clusters.cluster_means(_fixed_clusters(df))),
        "cluster_coverage": _on(scores, _coverage),
        "holdout_fixed": _on(scores, lambda df: models.holdout_report(df, "p_rf", "y_true")),
        "top_features_fixed": _on(scores, _top_rows),
        "insight_drivers": _on(scores, _drivers),
        "linear_attribution_fixed": _on(scores, _fixed_slopes),
    }


# --- sources and text functions --------------------------------------------------------------


def _view_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table read by path, published under a name, and read again by SQL."""
    publish(read_table(spark, f"{d}/orders.parquet"), "orders_view")
    return read_table(spark, "orders_view").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _columns_of(spark: SparkSession, d: str) -> DataFrame:
    return describe(read_table(spark, f"{d}/lineitem.parquet")).select("position", "col_name")


def _not_in_orders(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the line items that orders lack."""
    found = missing_columns(read_table(spark, f"{d}/orders.parquet"), read_table(spark, f"{d}/lineitem.parquet").columns)
    return spark.createDataFrame([(c,) for c in found], "col_name string")


def _document_files(spark: SparkSession, d: str) -> DataFrame:
    """The document written as a JSON file and read back under its key."""
    path = fresh_path(spark, "document")
    records = export.cohort_records(scores(spark, d), MODEL_SCORES)
    documents.write_document(export.assemble_document(records, list(MODEL_SCORES), "rf", generated_at="2024-01-01"), path)
    flat = documents.flatten(documents.read_dataset(spark, "main", {"main": path}))
    return flat.select("id", "model", "is_default", "population", "risk_score", F.size("trend").alias("points"))


def _trend_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trends of no to seven points of every customer, with their labels."""
    people = read_table(spark, f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 8).cast("int").alias("points"))
    value = lambda i: ((F.col("c_custkey") * 31 + i * i * 17) % 100) / F.lit(128.0)
    series = F.when(F.col("points") > 0, F.transform(F.sequence(F.lit(1), F.col("points")), value)).otherwise(F.array().cast("array<double>"))
    rows = people.withColumn("series", series)
    shown = [F.element_at(text.padded_trend(F.col("series")), i + 1).alias(f"t{i + 1}") for i in range(6)]
    # An empty series has no ends to look at.
    ends = F.when(F.col("points") > 0, F.col("series"))
    return rows.select(
        "c_custkey", *shown, text.trend_direction(ends).alias("direction"), text.trend_phrase(ends).alias("phrase"), text.pulse_label(ends).alias("pulse"),
        F.array_join(text.timeline_labels(F.col("points")), ",").alias("timeline"), text.one_in_n(F.try_element_at("series", F.lit(1))).alias("one_in"),
    )


def _text_rows(spark: SparkSession, d: str) -> DataFrame:
    people = read_table(spark, f"{d}/customer.parquet")
    return people.select("c_custkey", text.code_point_sum(F.col("c_mktsegment")).alias("seed"), text.thousands(F.col("c_custkey") * 1000).alias("shown"))


def source_queries() -> dict[str, Query]:
    return {
        "view_rows": _view_rows,
        "table_columns": _columns_of,
        "missing_columns": _not_in_orders,
        "document_files": lambda spark, d: rounded(_document_files(spark, d)),
        "trend_labels": lambda spark, d: rounded(_trend_rows(spark, d)),
        "text_seeds": _text_rows,
        "feature_labels": _on(scores, lambda df: attribution.label_features(_fixed_importance(df))),
    }


def _audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly calibration audit of a stream of scored orders, run to completion."""
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"
    arriving = spark.readStream.schema(schema).parquet(f"{d}/orders*.parquet")
    midnight = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400
    scored = arriving.select(
        F.timestamp_seconds(midnight).alias("at"),
        F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male").alias("sex"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        (F.col("o_orderkey") * 7919 % 1000 / 1000.0).alias("y_prob"),
    )
    out, state = fresh_path(spark, "audit"), fresh_path(spark, "audit-state")
    write_batches(scored, out, state, lambda batch: audit_sums(batch, "at", "sex")).awaitTermination()
    return rounded(audit_report(spark.read.parquet(out), "sex"))


def recurring_queries() -> dict[str, Query]:
    """The recurring jobs around the models: ranked worklist and streaming audit."""
    return {
        "monthly_worklist": _on(scores, monthly_worklist),
        "audit_stream": _audit_stream,
    }


def all_queries() -> dict[str, Query]:
    return (
        recurring_queries() | profile_queries() | score_queries() | matrix_queries() | export_queries()
        | fixed_queries() | source_queries() | fixed_models.queries() | model_queries()
    )
