"""The pipeline's stages on planted rows, and as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_clean_rows(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").filter(F.length("text") > 80).first()
    some = docs.filter("doc_id < 20")
    clean = "A quiet line about rivers and hills that nobody has written before today, and a second one."
    planted = spark.createDataFrame(
        [(9001, clean), (9002, clean), (9003, benchmark.text), (9004, "key token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f9\" end"), (9005, None), (9006, "")], "doc_id long, text string"
    ).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    rows = some.unionByName(planted)
    stages = dict(pipeline.STAGES)
    one = {r.doc_id: r for r in stages["near_duplicates"](spark, rows, SF).collect()}
    assert 9001 in one and 9002 not in one and {9003, 9004, 9005, 9006} <= one.keys()
    two = stages["decontamination"](spark, rows, SF)
    kept = {r.doc_id for r in two.collect()}
    assert 9003 not in kept and {9001, 9004, 9005, 9006} <= kept and two.columns == docs.columns
    three = {r.doc_id: r for r in stages["secrets"](spark, rows, SF).collect()}
    assert len(three) == rows.count() and "[SECRET]" in three[9004].text and "0a1b" not in three[9004].text and three[9004].n_chars == len(three[9004].text)
    assert three[9001].text == clean and three[9005].text is None and three[9006].text == ""
    assert all(stages[n](spark, docs.limit(0), SF).count() == 0 for n in stages)


def test_helper_columns_clash_with_nothing(spark, docs):
    named = docs.filter("doc_id < 12").select("*", *[F.concat(F.lit("kept "), F.col("doc_id")).alias(c) for c in ("hits", "_hits", "spans", "_spans", "row_key", "_row_key")])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, named, SF)
        assert out.columns == named.columns
        assert all(r[c] == f"kept {r.doc_id}" for r in out.collect() for c in named.columns[-6:]), name


def test_nulls_and_repeats_in_quality_and_packing(spark, docs):
    odd = spark.createDataFrame([(None, None), (None, ""), (7001, "one two"), (7001, "one two"), (7002, None)], "doc_id long, text string")
    rows = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    stages = dict(pipeline.STAGES)
    kept = stages["quality"](spark, docs.unionByName(rows), SF)
    assert kept.filter("doc_id = 7001").count() in (0, 2)
    packed = stages["packing"](spark, rows, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {None: 2, 7001: 2 * (packed_tokens("one two") + 1), 7002: 1}


def packed_tokens(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)


def test_run(spark, docs):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    packed = pipeline.run(spark, SF).toPandas()
    assert packed.sequence_id.is_unique and set(packed.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = labels[labels.quality == 1].doc_id
    assert np.mean(good.isin(set(packed.doc_id))) > 0.7
