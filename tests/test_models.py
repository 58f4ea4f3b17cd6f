import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from test_features import patients

from riskweave.operators import attribution as at, clusters as cl, metrics, models as m
from riskweave.operators.features import build_features
from riskweave.plans import reports, training
from riskweave.streaming import scoring

SMALL = m.Settings(rf_trees=8, rf_depth=4, gbt_rounds=6, gbt_depth=3, lr_iterations=50, min_leaf=5)


@pytest.fixture(scope="module")
def planted(spark):
    """Outcome driven by two flags and a visit count; race is noise."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1600):
        ckd, hf, visits = int(rng.random() < 0.4), int(rng.random() < 0.3), int(rng.integers(0, 9))
        risk = 1 / (1 + np.exp(-(3.0 * ckd + 2.0 * hf + 0.5 * visits - 4.5)))
        rows.append(
            {
                "EncMonth": 202001 + i % 10,
                "Outcome": int(rng.random() < risk),
                "cms_ccw_glaucoma_36": int(i % 3 != 0),
                "cms_ccw_diabetes_36": int(i % 3 != 1),
                "cms_ccw_chronic_kidney_disease_36": ckd,
                "cms_ccw_heart_failure_36": hf,
                "last_12months_officevisit_count": visits,
                "ADINatrank": None if i % 9 == 0 else float(i % 100),
                "last_12months_chronic_count": ckd + hf,
                "DerivedRaceEthnicity": "ABC"[i % 3],
            }
        )
    return patients(spark, *rows)


@pytest.fixture(scope="module")
def run(planted):
    return training.train_run(planted, SMALL)


def test_planted_signal_is_found(run):
    records = metrics.score_models(run.val, run.score_columns, "Outcome").collect()
    assert {r.model for r in records} == {"logreg", "rf", "gbt"}
    assert all(r.auroc > 0.8 for r in records)


def test_split_is_by_time_and_race_is_no_feature(run):
    assert run.val.agg(F.min("EncMonth")).first()[0] == 202009
    assert not [n for n in run.trained.encoding.names if "Race" in n or n.startswith("sex")]
    assert "flag_glaucoma" not in run.trained.encoding.names


def test_same_seed_gives_same_scores(run, planted):
    again = training.train_run(planted, SMALL)
    a = {r.patientID: (r.p_rf, r.p_gbt) for r in run.val.select("patientID", "p_rf", "p_gbt").collect()}
    b = {r.patientID: (r.p_rf, r.p_gbt) for r in again.val.select("patientID", "p_rf", "p_gbt").collect()}
    assert a == b


def test_calibration_uses_the_other_half(run):
    out = training.calibrated(run)
    halves = run.val.groupBy("half").count().collect()
    n = {r.half: r["count"] for r in halves}
    assert n["calibrate"] == sum(n.values()) // 2 and out.count() == n["evaluate"]
    s = out.select("p_calibrated", f"p_{run.best}").orderBy(f"p_{run.best}").collect()
    fitted = [r[0] for r in s]
    assert fitted == sorted(fitted) and 0 <= fitted[0] and fitted[-1] <= 1


def test_isotonic_interpolates_and_clips(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "s double, y int")
    model = m.fit_isotonic(df, "s", "y")
    asked = spark.createDataFrame([(-1.0,), (0.15,), (0.25,), (9.0,)], "s double")
    assert [r.c for r in m.apply_isotonic(asked, model, "s", "c").collect()] == pytest.approx([0.0, 0.25, 0.5, 1.0])


def test_comparison_has_all_models_best_first(run):
    got = training.comparison(run).collect()
    assert {r.model for r in got} == {"logreg", "rf", "gbt", f"{run.best}_calibrated", "stacker_calibrated"}
    assert [r.auroc for r in got] == sorted((r.auroc for r in got), reverse=True)
    assert len({r.n for r in got}) == 1
    stacked = next(r for r in got if r.model == "stacker_calibrated")
    assert stacked.auroc > 0.75


def test_specialised_models_and_small_groups(run):
    got = {r.subgroup: r for r in training.general_vs_specialised(run).collect()}
    assert got["Glaucoma+Diabetic"].status == "ok" and got["Glaucoma+Diabetic"].specialized_auroc > 0.6
    r = got["Diabetic only"]
    assert r.auroc_delta == pytest.approx(r.specialized_auroc - r.general_auroc, abs=2e-4)
    rubric = {r.subgroup: r for r in training.general_vs_specialised(run, "rubric", training.RUBRIC_TRAINED).collect()}
    assert rubric["Cancer only"].status == "too small" and rubric["Cancer only"].specialized_auroc is None


def test_verdicts(spark):
    df = spark.createDataFrame([(0.02,), (0.0,), (-0.02,), (None,)], "d double")
    assert [r[0] for r in df.select(m.two_way_verdict(F.col("d"))).collect()] == ["specialize", "general_sufficient", "general_sufficient", None]
    assert [r[0] for r in df.select(m.three_way_verdict(F.col("d"))).collect()] == ["specialize", "general sufficient", "general better", None]
    assert [r[0] for r in df.select(cl.cluster_verdict(F.col("d"))).collect()] == ["adopt", "no gain", "no gain", "no gain"]


def test_clusters(run):
    found = training.cluster_run(run, restarts=2)
    sizes = [r.n_train for r in cl.cluster_sizes(
        found.train.select("cluster", "split", "Outcome").unionByName(found.val.select("cluster", "split", "Outcome"))
    ).orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == run.train.count()
    means = training.cluster_profile(run, found)
    assert means.filter("feature = 'flag_ckd'").count() == found.train.select("cluster").distinct().count()
    # Unknown values count as the training median, over training rows only.
    median = run.trained.encoding.medians["ADINatrank"]
    filled = found.train.fillna({"ADINatrank": median}).groupBy("cluster").agg(F.avg("ADINatrank").alias("v"))
    got = {r.cluster: r["mean"] for r in means.filter("feature = 'ADINatrank'").collect()}
    assert got == {r.cluster: pytest.approx(r.v) for r in filled.collect()}
    got = {r.model: r for r in training.cluster_comparison(run, found).collect()}
    assert got["general"].auroc_delta == 0 and 0 < got["per_cluster"].covered <= 1
    assert got["cluster_feature"].verdict in {"adopt", "marginal", "no gain"}


def test_holdout_goes_through_training_steps(spark, run, planted, tmp_path):
    later = planted.withColumn("EncMonth", F.lit(202101)).withColumn("ADINatrank", F.lit(None).cast("double"))
    scored = training.score_holdout(run, later)
    report = {r.subgroup: r for r in m.holdout_report(scored, "p_calibrated").collect()}
    assert report["Overall"].auroc > 0.8 and report["Overall"].n == scored.count()
    assert sum(r.n for k, r in report.items() if k != "Overall") == report["Overall"].n
    # The saved unit holds the calibrator too, and scores a batch and a stream alike.
    run.scoring_unit().write().overwrite().save(str(tmp_path / "model"))
    unit = PipelineModel.load(str(tmp_path / "model"))
    want = {r.patientID: r.p_calibrated for r in scored.select("patientID", "p_calibrated").collect()}
    batch = training.score_rows(unit, build_features(later))
    assert {r.patientID: r.p_calibrated for r in batch.select("patientID", "p_calibrated").collect()} == want
    later.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(later.schema).parquet(str(tmp_path / "in"))
    arriving = scoring.score_stream(stream, lambda rows: training.score_rows(unit, rows)).select("patientID", "p_calibrated")
    scoring.write_batches(arriving, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.patientID: r.p_calibrated for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_trained_scores_carry_the_contract(run, spark):
    rows = training.publish_scores(run, "trained_scores_test")
    assert rows.columns == ["patientID", "y_true", "y_prob", "y_pred", "subgroup", "DerivedRaceEthnicity", "ADINatRankQuintile", "CAHPIQuartile"]
    read = spark.table("trained_scores_test")
    half = run.val.filter("half = 'evaluate'")
    assert read.count() == half.count() and read.join(half, "patientID").count() == half.count()
    assert metrics.evaluate(read).first().auroc > 0.75
    flagged = read.agg(F.avg("y_pred").alias("f"), F.sum(F.col("y_pred") * F.col("y_true")).alias("tp"), F.sum("y_true").alias("p")).first()
    assert 0 < flagged.f < 1 and flagged.tp / flagged.p >= 0.3
    report = reports.validation_report(read)
    assert report["decile lift"].agg(F.sum("n")).first()[0] == half.count() and report["confusion"].first().n == half.count()


@pytest.mark.parametrize("name", ["rf", "gbt"])
def test_tree_contributions_add_up_to_the_model(run, name):
    rows = run.val.limit(40)
    model = run.trained.models[name].stages[-1]
    parts = {r.patientID: r for r in at.tree_contributions(at.tree_nodes(model), rows).collect()}
    assert len(parts) == 40
    for r in rows.collect():
        want = model.predictProbability(r.features)[1] if name == "rf" else model.predictRaw(r.features)[1]
        assert parts[r.patientID].expected + sum(parts[r.patientID]["values"]) == pytest.approx(want, abs=1e-9)


def test_attribution_covers_all_rows_and_finds_the_planted_features(run):
    names = run.trained.encoding.names
    for name, pipeline in run.trained.models.items():
        found = at.attribution(run.val, pipeline, names)
        top = [r.feature for r in at.strongest(found, 4).collect()]
        assert "flag_ckd" in top and "last_12months_officevisit_count" in top
        if name == "rf":
            each = at.tree_contributions(at.tree_nodes(pipeline.stages[-1]), run.val)
            i = names.index("flag_ckd")
            want = each.agg(F.avg(F.abs(F.col("values")[i]))).first()[0]
            assert each.count() == run.val.count()
            assert found.filter("feature = 'flag_ckd'").first().mean_abs_shap == pytest.approx(want)


def test_top_features_are_labelled_shares(run, spark):
    imp = at.importances(spark, run.trained.models, run.trained.encoding.names)
    got = {r.model: r.top_features for r in at.top_features(imp).collect()}
    assert all(len(v) == 3 and sum(f.importance for f in v) == pytest.approx(1, abs=0.01) for v in got.values())
    assert "Chronic Kidney Disease" in {f.feature for f in got["rf"]}


def test_unknown_model(run):
    with pytest.raises(ValueError, match="unknown model"):
        m.fit_one("svm", run.train, SMALL)
