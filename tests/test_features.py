import pytest
from pyspark.sql import Row, functions as F

from riskweave.functions import columns as c, text
from riskweave.operators import encode, profile, split
from riskweave.operators.features import FEATURE_VIEW_COLUMNS, NUMERIC_FEATURES, SOURCE_COLUMNS, build_features
from riskweave.operators.groups import exclusive_label, explode_memberships, rubric_conditions
from riskweave.sources import tables


def patients(spark, *overrides):
    base = {n: (0 if t.simpleString() == "int" else 1.0 if t.simpleString() == "double" else 1) for n, t in SOURCE_COLUMNS.items()}
    base |= {"EncMonth": 202101, "DerivedRaceEthnicity": "A", "MaritalStatus": "M", "sex": "F", "cms_ccw_glaucoma_36": 1}
    rows = [tuple((base | {"patientID": i} | o)[n] for n in SOURCE_COLUMNS) for i, o in enumerate(overrides)]
    return spark.createDataFrame(rows, tables.patient_schema())


def test_view_has_all_columns_in_order(spark):
    out = build_features(patients(spark, {}))
    assert out.columns == FEATURE_VIEW_COLUMNS and len(out.columns) == 44
    assert len(NUMERIC_FEATURES) == 33


def test_cohort_filter(spark):
    df = patients(
        spark, {}, {"Outcome": None}, {"cms_ccw_glaucoma_36": 0}, {"cms_ccw_glaucoma_36": 0, "cms_ccw_diabetes_36": 1}
    )
    assert [r.patientID for r in build_features(df).orderBy("patientID").collect()] == [0, 3]


def test_nulls_and_thresholds(spark):
    df = patients(
        spark,
        {"ADINatrank": None, "CAHPIPercentile": None, "straight_line_distance_miles": None},
        {"ADINatrank": 80.0, "CAHPIPercentile": 25.0, "straight_line_distance_miles": 10.0},
        {"straight_line_distance_miles": 10.5, "last_12months_officevisit_distinct_specialty": 3},
    )
    a, b, d = build_features(df).orderBy("patientID").collect()
    assert (a.high_deprivation, a.low_cahpi, a.far_from_care, a.distance_log) == (0, 0, 0, None)
    assert (b.high_deprivation, b.low_cahpi, b.far_from_care) == (1, 1, 0)
    assert (d.far_from_care, d.high_specialty_breadth) == (1, 1)


def test_ratios_and_cancer(spark):
    df = patients(
        spark,
        {"last_6months_officevisit_count": 2, "Specialty_cardiology": 1},
        {"cms_ccw_colorectal_cancer_36": 1, "cms_ccw_lung_cancer_36": None, "cms_ccw_diabetes_36": 1},
    )
    a, b = build_features(df).orderBy("patientID").collect()
    assert a.op_recency_ratio == pytest.approx(2000) and a.cardio_visit_ratio == pytest.approx(1000)
    assert b.flag_cancer == 1 and b.flag_glaucoma_diabetic == 1


def test_scan_reads_only_needed_columns_and_pushes_the_cohort_filter(spark, tmp_path):
    patients(spark, {}, {}).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = build_features(spark.read.parquet(str(tmp_path / "p")), ["patientID", "flag_ckd"])
    text_ = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Outcome), Or(EqualTo(cms_ccw_glaucoma_36,1),EqualTo(cms_ccw_diabetes_36,1))]" in text_
    schema = text_.split("ReadSchema: struct<")[1].split(">")[0]
    assert {f.split(":")[0] for f in schema.split(",")} == {
        "patientID", "Outcome", "cms_ccw_glaucoma_36", "cms_ccw_diabetes_36", "cms_ccw_chronic_kidney_disease_36"
    }


def test_one_scan_for_overlapping_groups(spark, tmp_path):
    patients(spark, {"cms_ccw_diabetes_36": 1}, {}).write.parquet(str(tmp_path / "p"))
    out = profile.overlap_rates(spark.read.parquet(str(tmp_path / "p")))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(r.subgroup, r.n) for r in out.collect()} == {("Glaucoma", 2), ("Diabetic", 1), ("Glaucoma+Diabetic", 1)}


def test_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)], "flag_glaucoma int, flag_diabetes int")
    got = [r[0] for r in df.select(exclusive_label()).collect()]
    assert got == ["Glaucoma+Diabetic", "Glaucoma only", "Diabetic only", "Neither", "Diabetic only"]


def test_rubric_groups(spark):
    df = spark.createDataFrame([(0, 1, 0, 0), (1, 1, 1, 0), (2, 0, 0, 0)], "id int, flag_ckd int, flag_hf int, flag_cancer int")
    got = explode_memberships(df, rubric_conditions()).groupBy("id").agg(F.sort_array(F.collect_set("subgroup")).alias("s"))
    assert {r.id: r.s for r in got.collect()} == {
        0: ["CKD (any)", "CKD only"], 1: ["CKD (any)", "HF (any)", "Multi-condition"]
    }


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 4.0, 0), (1.0, None, 1)], "a double, b double, Outcome int")
    got = {r.feature: r.r for r in profile.correlations(df, {"ra": "a", "rb": "b"}).collect()}
    assert got["ra"] is None and got["rb"] == pytest.approx(-1.0)


def test_describe_and_missing(spark):
    df = patients(spark, {})
    assert tables.describe(df).filter("col_name = 'sex'").first().data_type == "string"
    assert tables.missing_columns(df, ["sex", "nope"]) == ["nope"]
    with pytest.raises(ValueError, match="nope"):
        tables.require_columns(df, ["nope"])
    tables.publish(df, "people")
    assert tables.read_table(spark, "people").count() == 1 and tables.preview(df, 0).count() == 0


def test_align_columns(spark):
    out = tables.align_columns(spark.createDataFrame([(1, 2)], "a int, extra int"), ["a", "gone"])
    assert out.first() == Row(a=1, gone=0.0)


def test_split_uses_int_of_share(spark):
    df = spark.createDataFrame([(i, 202001 + i) for i in range(7)], "id int, EncMonth int")
    got = {r.EncMonth: r.split for r in split.temporal_split(df).collect()}
    assert [got[202001 + i] for i in range(7)] == ["train"] * 5 + ["val"] * 2


def test_folds_are_stable_and_even(spark):
    df = spark.range(5000).withColumnRenamed("id", "patientID")
    sizes = [r["count"] for r in df.groupBy(split.fold()).count().collect()]
    assert len(sizes) == 5 and min(sizes) > 850
    again = df.repartition(3).withColumn("f", split.fold()).join(df.withColumn("g", split.fold()), "patientID")
    assert again.filter("f <> g").count() == 0


def test_medians(spark):
    rows = [(1.0, None, i) for i in range(3)] + [(4.0, None, 9), (None, None, 10)]
    df = spark.createDataFrame(rows, "a double, b double, c int")
    assert {r["column"]: r["median"] for r in encode.column_medians(df, ["a", "b", "c"]).collect()} == {"a": 1.0, "c": 2.0}
    even = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "a double")
    assert encode.column_medians(even, ["a"]).first()["median"] == 2.5


def test_sparse_column_keeps_its_median(spark, many_buckets):
    df = spark.range(5000).select(F.when(F.col("id") == 4321, 7.0).alias("rare"), F.col("id").cast("double").alias("x"))
    got = {r["column"]: r["median"] for r in encode.column_medians(df, ["rare", "x"]).collect()}
    assert got == {"rare": 7.0, "x": 2499.5}


def test_encoding_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None)], "x double, sex string")
    later = spark.createDataFrame([(None, "z"), (9.0, "b"), (None, None)], "x double, sex string")
    enc = encode.fit_encoding(train, ["x"], ["sex"], sensitive_as_features=True)
    assert enc.names == ["x", "sex_b", "sex_nan"]
    out = enc.stages()[0].transform(later).select("x_x", "x_sex_b", "x_sex_nan").collect()
    assert [tuple(r) for r in out] == [(2.0, 0.0, 0.0), (9.0, 1.0, 0.0), (2.0, 0.0, 1.0)]
    assert encode.fit_encoding(train, ["x"], ["sex"]).names == ["x"]
    with pytest.raises(ValueError, match="too many levels"):
        encode.category_levels(train, ["sex"], max_levels=1)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "Outcome int")
    got = encode.balance_weights(df).groupBy("Outcome").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(2.0) for r in got)


def test_text_helpers(spark):
    df = spark.createDataFrame([([0.1, 0.3],), ([0.3, 0.1],), ([0.2, 0.2],), ([0.4],), ([],)], "t array<double>")
    way = [r[0] for r in df.select(text.trend_direction(F.col("t"))).collect()]
    assert way == ["worsening", "improving", "flat", "limited", "limited"]
    assert [r[0] for r in df.select(text.is_worsening(F.col("t"))).collect()] == [True, False, False, False, False]
    padded = [r[0] for r in df.select(text.padded_trend(F.col("t"))).collect()]
    assert padded[0] == [0.0, 0.0167, 0.0333, 0.05, 0.1, 0.3]
    assert padded[4] == [0.0, 0.0083, 0.0167, 0.025, 0.0333, 0.0417]
    labels = spark.createDataFrame([(1,), (6,)], "n int").select(text.timeline_labels(F.col("n"))).collect()
    assert [r[0] for r in labels] == [["+12m"], ["now", "+2m", "+5m", "+7m", "+10m", "+12m"]]
    one = spark.range(1).select(
        text.whole_percent(F.lit(0.125)).alias("p"), text.one_in_n(F.lit(0.3)).alias("n"), text.one_in_n(F.lit(0.0)).alias("z"),
        text.code_point_sum(F.lit("ab")).alias("s"), text.thousands(F.lit(12345)).alias("t"),
    ).first()
    assert tuple(one) == ("13%", 3, None, 195, "12,345")


def test_column_helpers(spark):
    df = spark.createDataFrame([(0.15,), (0.07,), (0.0699,)], "p double")
    assert [r[0] for r in df.select(c.risk_level("p")).collect()] == ["high", "moderate", "low"]
    assert df.select(c.logit(F.lit(0.5))).first()[0] == pytest.approx(0.0, abs=1e-8)
    assert str(spark.range(1).select(c.month_start(F.lit(202103))).first()[0]) == "2021-03-01"
