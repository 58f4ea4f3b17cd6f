import time

import pytest
from pyspark.sql import functions as F

from riskweave.operators import export, insights, worklist
from riskweave.sources import documents
from riskweave.streaming import scoring

MODELS = {"logreg": "p1", "gbt": "p2"}


@pytest.fixture
def scored(spark):
    rows = []
    for i in range(60):
        sg = ["Glaucoma only", "Diabetic only"][i % 2]
        rows.append((i, 202001 + i % 8, sg, 0.1 + (i % 2) * 0.2 + (i % 8) / 100, 0.05, i % 4))
    return spark.createDataFrame(
        rows, "patientID long, EncMonth int, subgroup string, p1 double, p2 double, last_12months_chronic_count int"
    )


def build(scored, features=None, default="logreg"):
    records = export.cohort_records(scored, MODELS, features)
    return export.assemble_document(records, list(MODELS), default, generated_at="2024-01-01", validation_auroc=0.7)


def test_document_through_a_file(spark, scored, tmp_path):
    path = str(tmp_path / "doc")
    documents.write_document(build(scored), path)
    back = documents.read_dataset(spark, "actual", {"actual": path})
    doc = back.first()
    assert [c.id for c in doc.cohorts] == ["cohort_glaucoma", "cohort_diabetic"]
    assert doc.metadata.validation_n == 60 and doc.metadata.models_available == ["logreg", "gbt"]
    assert set(doc.cohorts[0].models) == {"logreg", "gbt"} and len(doc.cohorts[0].models["gbt"].trend) == 6
    assert doc.cohorts[0].auroc is None and doc.cohorts[0].position.x == -1.4
    flat = documents.flatten(back).collect()
    assert len(flat) == 4 and sum(r.is_default for r in flat) == 2
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert '\n  "metadata"' in text


def test_unknown_keys(spark, scored):
    with pytest.raises(ValueError, match="unknown dataset key"):
        documents.read_dataset(spark, "nope", {"actual": "x"})
    cohorts = documents.default_cohorts(build(scored))
    assert documents.select_cohort(cohorts, "cohort_diabetic").count() == 1
    with pytest.raises(Exception, match="unknown cohort id: nope"):
        documents.select_cohort(cohorts, "nope").collect()


def test_reads_documents_with_absent_fields(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"metadata": {"project": "x \\u2014 y", "default_model": "a"}, "cohorts": [{"id": "c", "population": 3,\n'
        ' "models": {"a": {"risk_score": 0.2, "trend": [0.1], "top_features": [{"feature": "N/A", "importance": 0}]}}}]}'
    )
    df = documents.read_documents(spark, str(tmp_path / "d.json"))
    row = documents.default_cohorts(df).first()
    assert row.auroc is None and row.metadata.validation_n is None and row.metadata.project == "x — y"
    got = insights.insights(documents.default_cohorts(df)).first()
    assert got.riskDrivers == [insights.NO_DRIVERS]
    assert "limited trend data" in got.trendInterpretation


def test_burden(scored):
    got = {r.subgroup: r for r in export.disease_burden(scored).collect()}
    assert got["Glaucoma only"].disease_burden == round(1 / 3, 3) and got["Diabetic only"].disease_burden == round(2 / 3, 3)
    blank = export.disease_burden(scored.drop("last_12months_chronic_count")).collect()
    assert {r.disease_burden for r in blank} == {0.5}


def cohorts(spark, pairs):
    meta = F.struct(F.lit("m").alias("default_model"))
    rows = [(str(i), b, r) for i, (b, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id string, disease_burden double, r double")
    return df.select("id", "disease_burden", F.struct(F.col("r").alias("risk_score")).alias("model"), meta.alias("metadata"))


@pytest.mark.parametrize(
    "pairs, basis, depth",
    [
        ([(0.2, 0.5), (0.6, 0.1), (0.4, 0.3)], "disease burden", [0.0, 1.0, 0.5]),
        ([(0.5, 0.1), (0.5, 0.3)], "risk score", [0.0, 1.0]),
        ([(0.5, 0.3), (0.5, 0.3)], "risk score", [0.0, 0.0]),
    ],
)
def test_depth(spark, pairs, basis, depth):
    got = insights.with_depth(cohorts(spark, pairs)).orderBy("id").collect()
    assert [r.normalized_disease_burden for r in got] == pytest.approx(depth)
    assert {r.depth_basis for r in got} == {basis}
    first = insights.ranked_cohorts(insights.with_depth(cohorts(spark, pairs))).first()
    assert first.normalized_disease_burden == max(depth)


def test_insights_name_drivers(spark, scored):
    features = spark.createDataFrame(
        [("logreg", [("Heart Failure", 0.625), ("N/A", 0.1)]), ("gbt", [])],
        "model string, top_features array<struct<feature:string,importance:double>>",
    )
    got = insights.validate_insights(insights.insights(documents.default_cohorts(build(scored, features)))).collect()
    assert all(r.riskDrivers == ["Heart Failure (63%)"] and r.status == "ok" and len(r.caveats) == 2 for r in got)
    broken = insights.validate_insights(insights.insights(documents.default_cohorts(build(scored))).drop("caveats"))
    assert {r.status for r in broken.collect()} == {"missing list field: caveats"}


def test_worklist(spark):
    df = spark.createDataFrame([(i, 202001 + i % 2, (i % 7) / 10) for i in range(200)], "patientID long, EncMonth int, y_prob double")
    got = worklist.monthly_worklist(df).collect()
    assert len(got) == 30 and {r.place for r in got} == set(range(1, 16))
    for month in (202001, 202002):
        rows = sorted((-r.y_prob, r.patientID) for r in df.collect() if r.EncMonth == month)
        assert [r.patientID for r in sorted(got, key=lambda r: r.place) if r.EncMonth == month] == [i for _, i in rows[:15]]


def test_audit_of_a_stream_equals_the_table(spark, tmp_path):
    """Files arrive latest first, one to a batch: no row is lost."""
    rows = [(f"20{20 + i // 100}-0{1 + i % 5}-11 00:00:00", "ab"[i % 2], i % 3 == 0, (i % 10) / 10) for i in range(300)]
    table = spark.createDataFrame(rows, "t string, sex string, y boolean, y_prob double").select(
        F.col("t").cast("timestamp").alias("at"), "sex", F.col("y").cast("int").alias("y_true"), "y_prob"
    )
    for year in (2022, 2021, 2020):
        table.filter(F.year("at") == year).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of their time stamps
    want = sorted(scoring.audit_windows(table, "at", "sex").select("period_start", "sex", "n", F.round("cal_gap", 9)).collect())
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = scoring.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda batch: scoring.audit_sums(batch, "at", "sex"))
    query.awaitTermination()
    sums = spark.read.parquet(str(tmp_path / "out"))
    assert sums.select("batch").distinct().count() == 3 and sums.agg(F.sum("n")).first()[0] == 300
    got = scoring.audit_report(sums, "sex")
    assert sorted(got.select("period_start", "sex", "n", F.round("cal_gap", 9)).collect()) == want


def test_scores_a_stream_with_the_batch_steps(spark, tmp_path):
    from test_features import patients

    table = patients(spark, {}, {"Outcome": None}, {"cms_ccw_glaucoma_36": 0})
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    scored = scoring.score_stream(stream, lambda df: df.withColumn("p", F.lit(0.3))).select("patientID", "subgroup", "p")
    scoring.write_batches(scored, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()] == [(0, "Glaucoma only", 0.3)]


def test_reports_have_every_section(spark, capsys):
    from conftest import SF_DIR

    from riskweave.plans import reports
    from riskweave.sources.adapter import patient_level, scores

    eda = reports.eda_report(patient_level(spark, SF_DIR))
    assert len(eda) == 7 and eda["missing values"].count() == 5 and eda["subgroups"].count() == 5
    validation = reports.validation_report(scores(spark, SF_DIR))
    assert len(validation) == 7 and validation["decile lift"].count() == 10
    reports.show({"months": eda["months"]})
    assert "n_months" in capsys.readouterr().out
