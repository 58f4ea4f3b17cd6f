"""What the classifier learns from does not depend on tasks or repeats."""

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import quality

SF = "/root/testdata/sf0.001"


def test_model_is_the_same_whatever_the_partitioning_and_repeats(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = quality.train(docs, labels)
    other = quality.train(docs.repartition(5).unionByName(docs.filter("doc_id % 3 = 0")), labels.repartition(3))
    assert one.bias == other.bias and (one.weights == other.weights).all() and (one.factors == other.factors).all()
    # Of two texts under one id the same one is learned, whichever comes first.
    twice = docs.withColumn("text", F.concat("text", F.lit(" more")))
    assert (quality.train(docs.unionByName(twice), labels).weights == quality.train(twice.unionByName(docs), labels).weights).all()


def test_bound_on_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    few = quality.train(docs, labels, max_rows=20)
    every = quality.train(docs, labels)
    assert not np.array_equal(few.weights, every.weights) and np.isfinite(few.weights).all()
