"""Isotonic fits as blocks that merge: no task and no driver holds the scores.

Equal scores are one run with its outcomes and rows. Runs are dealt out by range of score; a task pools its range into
the fewest increasing blocks in one pass, and blocks of neighbouring ranges are pooled again, ``MERGED`` ranges at a
time, until one range is left. Pooling pooled blocks gives what pooling their runs would: each block holds its
sum and its rows. Groups are fitted side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from riskweave.session import materialise, ship

MERGED = 16


def pool(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks (key, low, high, sum, rows) with increasing means within a key, from such rows in order of key and low."""
    held: list[list] = []
    for key, low, high, total, n in rows:
        if held and held[-1][0] != key:
            yield from map(tuple, held)
            held = []
        held.append([key, low, high, total, n])
        # A block that does not lie above the one before it joins it.
        while len(held) > 1 and held[-2][3] * held[-1][4] >= held[-1][3] * held[-2][4]:
            _, _, high, total, n = held.pop()
            held[-1][2], held[-1][3], held[-1][4] = high, held[-1][3] + total, held[-1][4] + n
    yield from map(tuple, held)


def isotonic_blocks(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, low, high, fitted, n): the steps of the increasing fit of label on score, in every group.

    Rows with a null or NaN score or a null label have no part.
    """
    keys = list(by)
    value, outcome = F.col(score).cast("double"), F.col(label).cast("double")
    usable = df.filter(value.isNotNull() & ~F.isnan(value) & outcome.isNotNull()).select(*keys, (value + 0.0).alias("low"), outcome.alias("y"))
    return blocks_of_runs(usable.groupBy(*keys, "low").agg(F.sum("y").alias("total"), F.count(F.lit(1)).alias("n")), keys)


def blocks_of_runs(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from runs: rows (by, low, total, n) of one score each, with the sum of its labels and its rows."""
    ship(runs.sparkSession)
    keys = list(by)
    order = [*keys, "low"]
    fields = [runs.schema[k] for k in keys] + [StructField(c, DoubleType()) for c in ("low", "high", "total")] + [StructField(c, LongType()) for c in ("n", "range")]
    schema = StructType(fields)
    names, k = schema.names, len(keys)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    yield (r[:k], r[-1]), *r[k : k + 4]

        out: list[tuple] = []
        for (key, at), low, high, total, n in pool(rows()):
            out.append((*key, low, high, total, n, at))
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = [*keys, "low", F.col("low").alias("high"), "total", "n", F.spark_partition_id().cast("long").alias("range")]
    ready = dealt.select(*columns)
    types = [to_arrow_type(f.dataType) for f in schema]
    blocks = materialise(ready.mapInArrow(pooled, schema), "isotonic")
    while (blocks.agg(F.max("range")).first()[0] or 0) > 0:
        wider = blocks.withColumn("range", F.floor(F.col("range") / MERGED))
        wider = wider.repartition("range", *keys).sortWithinPartitions("range", *order).select(*names)
        blocks = materialise(wider.mapInArrow(pooled, schema), "isotonic")
    return blocks.select(*keys, "low", "high", (F.col("total") / F.col("n")).alias("fitted"), "n")



# --- recurring recalibration ---------------------------------------------------------------------


def calibration_state(df: DataFrame, score: str, label: str, month: str) -> DataFrame:
    """(month, score, n, positives): all that a later refit needs of a month's rows."""
    usable = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    rows = usable.select(F.col(month).alias("month"), (F.col(score).cast("double") + 0.0).alias("score"), F.col(label).cast("bigint").alias("y"))
    return rows.groupBy("month", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all rows behind several states: sums, in any order. Rows that came late are a state of their own."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("month", "score").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def recalibrated(state: DataFrame, months: int) -> DataFrame:
    """(as_of, low, high, fitted, n): for every month of the state, the fit of the ``months`` that end with it.

    Months are yyyymm. Rows are not read again: windows add up the months' sums.
    """
    number = lambda c: F.floor(c / 100) * 12 + c % 100 - 1
    known = state.select(number(F.col("month")).alias("m")).distinct()
    last = known.agg(F.max("m")).scalar()
    reach = F.explode(F.sequence(F.col("m"), F.least(F.col("m") + months - 1, last))).alias("a")
    windows = state.withColumn("m", number(F.col("month"))).select("score", "n", "positives", reach)
    # Months without a row have no fit of their own.
    windows = windows.join(known.withColumnRenamed("m", "a"), "a", "left_semi")
    runs = windows.groupBy("a", F.col("score").alias("low")).agg(F.sum("positives").cast("double").alias("total"), F.sum("n").alias("n"))
    fits = blocks_of_runs(runs, ["a"])
    as_of = (F.floor(F.col("a") / 12) * 100 + F.col("a") % 12 + 1).cast("int")
    return fits.select(as_of.alias("as_of"), "low", "high", "fitted", "n")
