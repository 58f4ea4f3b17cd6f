"""Importance resampling towards a target distribution.

A text's features are its runs of one to ``n`` consecutive words, each in one of ``buckets`` hash
buckets. Bucket counts of the source and of the target give every bucket a gain, the logarithm
of the ratio of its two smoothed shares. A document's weight is the sum of the gains
of its features; Gumbel noise fixed by the seed and the id turns weights into
scores whose highest are a draw without replacement.

1. Bucket counts: tasks add up an array of ``buckets`` counts each; the arrays meet in one row per bucket.
2. Weights: the gains, an array of ``buckets`` longs, go to every task; a document's buckets index it.
3. The scores are written to the shared folder. The cutoff is found by numeric bisection: an interval of
   scores is halved ``CUTS_AT_ONCE`` ways by one exact count job over the written table, until one score is left.
   The rows tied there are cut at an id the same way, and rows tied in both at a number of features.
4. Rows before the cut are dealt out by range of (score, id) and numbered by running counts and the ranges' totals.
   No row is sorted by one task, and rows that are not drawn are not moved.

Cases: a null or empty text has no features and weight 0. A null id counts as the empty text in the noise and comes
before all other ids in ties. Repeated rows are rows of their own; rows equal in score and id go by fewer features, and
equal rows are interchangeable. Ids are integers. An empty table gives no rows, and an empty target
counts no feature. A task holds one text's words at a time, whatever its length. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskweave.llm.common import alnum_words, ship, table
from riskweave.session import materialise

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
CUTS_AT_ONCE = 15  # cut points that one count job tries
_LOWEST = -(1 << 63)


def text_buckets(text: str | None, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, buckets of all features) of a whole text."""
    words = alnum_words(text)
    found = [np.fromiter(map(crc32, words), np.int64, len(words))]
    for size in range(2, n + 1):
        runs = (b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
        found.append(np.fromiter(map(crc32, runs), np.int64, max(0, len(words) - size + 1)))
    return len(words), np.concatenate(found) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                total += np.bincount(text_buckets(text.as_py(), n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row per bucket
    out = np.zeros(buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share of a bucket over the source's, both smoothed, rounded down."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * of_source / ((s + 1) * of_target))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def score_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, without a shuffle of documents."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_text, n, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            words, sizes, weights = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for i, text in enumerate(b.column(1)):
                words[i], found = text_buckets(text.as_py(), n, buckets)
                sizes[i], weights[i] = len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(sizes), pa.array(weights)], ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = slim.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def smallest_bound(rows: DataFrame, key: str, need: int) -> tuple[int, int]:
    """(value, rows under it): the smallest value of ``key`` that at least ``need`` rows do not exceed.

    Every job counts the rows up to each of a few cut points exactly; the interval that holds the answer is kept.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    under = 0
    while low < high:
        # The answer is in [low, high]; ``under`` rows are below low.
        step = max(1, -(-(high - low + 1) // (CUTS_AT_ONCE + 1)))
        cuts = [c for c in range(low + step - 1, high, step)][:CUTS_AT_ONCE]
        upto = rows.agg(*[F.count_if(F.col(key) <= F.lit(c)).alias(str(i)) for i, c in enumerate(cuts)]).first()
        for cut, n in zip(cuts, upto):
            if n >= need:
                high = cut
                break
            low, under = cut + 1, n
    return low, under


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with ``rank``: 1, 2, 3, ... for the drawn ones, by falling score, then id, then features; null for others.

    ``scored`` is a written table. ``percent`` of the rows with ``least_words`` words are drawn, rounded down.
    """
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    keyed = scored.select(*columns, (F.col("n_words") >= least_words).alias("may"), (-F.col("score")).alias("k1"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("k2"))
    open_to = keyed.filter("may")
    need = percent * open_to.count() // 100
    if not need:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # Three keys, one after the other: each is cut among the rows that tie in those before it.
    left, tied, before, cut_at = need, open_to, F.lit(False), F.lit(True)
    for key in ("k1", "k2", "n_features"):
        bound, under = smallest_bound(tied, key, left)
        left -= under
        before = before | (cut_at & (F.col(key) < F.lit(bound)))
        cut_at = cut_at & (F.col(key) == F.lit(bound))
        tied = tied.filter(F.col(key) == F.lit(bound))
    # Equal rows are one row with a count, so that no number of copies crowds a range. Of those at the cut, ``left`` are drawn.
    equal = lambda rows: rows.groupBy("k1", "k2", *columns).agg(F.count(F.lit(1)).alias("copies"))
    some = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    at_cut = equal(open_to.filter(cut_at))
    drawn = equal(open_to.filter(before)).unionByName(at_cut.withColumn("copies", F.lit(left).cast("long")))
    ranked = _numbered(drawn)
    taken = ranked.select(*columns, some(F.col("copies")).alias("i"), "first").select(*columns, (F.col("first") + F.col("i") - 1).alias("rank"))
    spare = at_cut.filter(F.col("copies") > left).select(*columns, some(F.col("copies") - left)).select(*columns)
    others = keyed.filter(~(F.col("may") & (before | cut_at))).select(*columns).unionByName(spare)
    return taken.unionByName(others.withColumn("rank", F.lit(None).cast("long")))


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``first``, the place (from 1) of a row's first copy in the order of its keys."""
    order = ["k1", "k2", "n_features"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id().cast("long"))
    schema = StructType([*dealt.schema.fields, StructField("upto", LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for b in batches:
            upto = held + np.cumsum(b.column(names.index("copies")).to_numpy())
            if len(upto):
                held = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto, pa.int64())], names)

    # Written with the range numbers, so that totals and places come from the same dealing.
    written = materialise(dealt.mapInArrow(run, schema), "drawn")
    totals = sorted((r["range"], r.n) for r in written.groupBy("range").agg(F.max("upto").alias("n")).collect())  # one row per range
    starts, at = [], 0
    for number, n in totals:
        starts.append((number, at))
        at += n
    dim = rows.sparkSession.createDataFrame(starts, "range long, start long")
    return written.join(F.broadcast(dim), "range").withColumn("first", F.col("start") + F.col("upto") - F.col("copies") + 1)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialise(score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "resample-scores")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END"


def crc32_sql(text: str) -> str:
    """DuckDB SQL: the unsigned crc32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"CAST(CAST('0x' || substr(hex({text}), 2 * i + 1, 2) AS INTEGER) AS BIGINT)"
    bytes_ = f"list_transform(range(strlen({text})), lambda i: {byte})"
    eight = f"list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, s: {_CRC_STEP}, xor(a, b))"
    return f"xor(list_reduce({bytes_}, lambda a, b: {eight}, 4294967295::BIGINT), 4294967295::BIGINT)"


def op12_sql() -> str:
    words = lambda t: f"SELECT {t}, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM"
    return f"""
    WITH docs AS ({words("doc_id, row_number() OVER () AS row_no")} documents),
    target AS ({words("item_id")} benchmark),
    doc_words AS (SELECT row_no, unnest(words) AS w FROM docs),
    target_words AS (SELECT unnest(words) AS w FROM target),
    known AS (SELECT w, {crc32_sql("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM doc_words UNION SELECT w FROM target_words)),
    s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN known USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM target_words JOIN known USING (w) GROUP BY bucket),
    total AS (SELECT (SELECT count(*) FROM doc_words) AS s, (SELECT count(*) FROM target_words) AS t),
    gain AS (
        SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * CAST(total.s + {BUCKETS} AS DOUBLE)
            / ((s.n + 1) * CAST(total.t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (bucket), total),
    weight AS (SELECT row_no, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN known USING (w) JOIN gain USING (bucket) GROUP BY row_no),
    scored AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((
                CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
        FROM docs LEFT JOIN weight USING (row_no)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features) AS place,
            count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n
        FROM scored)
    SELECT doc_id, n_features, weight, score,
        CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank
    FROM placed"""
