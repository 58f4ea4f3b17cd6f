"""Documents to training sequences: five stages, each over all that the one before kept.

1. quality: documents that the classifier scores under 0.7 go.
2. near_duplicates: of each class of linked documents (five-word shingles, similarity of 0.8 or more) the one with the
   smallest id stays.
3. decontamination: documents that a benchmark contaminates go.
4. secrets: secrets are masked in the texts, whose stored length follows; all documents stay.
5. packing: the documents as power-of-two sequences of token ids.

Cases, in every stage: columns that the stage does not name are kept as they are, whatever their names (helper columns take
names that the documents do not have). A null id is a value like any other, a null or empty text
has no words. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.llm import decontaminate, jaccard, packing, quality, secrets
from riskweave.llm.common import fold, ship, table
from riskweave.session import materialise

# The job's limits for near duplicates; op3's query has its own.
WORDS = 5
PERCENT = 80


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until the documents have no such column."""
    while wanted.lower() in {c.lower() for c in docs.columns}:
        wanted = f"_{wanted}"
    return wanted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.7 or more, by a model of the labelled rows that op2 learns from.

    Null and empty texts are scored by their structure. Repeated rows get equal scores and stay or go together; a score of exactly 0.7 stays.
    Without labelled rows every score is 0.5, and all rows go.
    """
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 4) != 2)
    return docs.filter(quality.score_of(F.col("text"), F.col("n_chars"), model, spark) >= quality.KEEP_AT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: texts that share `PERCENT` per cent of their `WORDS`-word shingles.

    Texts without words are linked with nothing, but of wholly repeated rows (id and text) one stays. Of a class the smallest id stays, nulls
    last; among equal ids the text decides.
    """
    ship(spark)
    return jaccard.one_of_each(docs, n=WORDS, percent=PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated: of whose words less than a twentieth, or none, lies in benchmark windows.

    Texts without words stay. Repeated rows are judged alike. An empty benchmark contaminates nothing.
    """
    ship(spark)
    name = free_name(docs, "hits")
    found = docs.withColumn(name, decontaminate.hits_of(F.col("text"), table(spark, sf_dir, "benchmark")))
    bad = decontaminate.is_contaminated(decontaminate.n_hit(F.col(name)), F.col(f"{name}.n_words"))
    return found.filter(~bad).drop(name)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked; only masked texts change, and only their stored length is set anew. Null texts stay null."""
    name = free_name(docs, "spans")
    spans = docs.withColumn(name, secrets.spans_of(F.coalesce(F.col("text"), F.lit(""))))
    has = F.size(name) > 0
    masked = spans.withColumn("text", F.when(has, secrets.redact(F.col("text"), F.col(name))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit), sequences and offsets; a null text is an empty one, and repeated rows are packed each."""
    ship(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Hashing, a fitted model and a tokeniser are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
