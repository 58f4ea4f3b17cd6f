"""The pipeline's near-duplicate stage against all pairs of planted copies."""

import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
        texts.append(words)
        for changed in (1, 2, 3, 4, 5, 6, 8, 12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), max(1, changed * len(copy) // 200)):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    similar = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
    assert any(0.8 <= s < 0.85 for s in similar.values()) and any(0.85 <= s < 0.9 for s in similar.values()) and any(0.7 < s < 0.8 for s in similar.values())
    root = list(range(len(texts)))
    for (i, j), s in similar.items():
        if s >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(root)
