"""Encoding fitted on training rows: medians, category levels, balanced weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from riskweave.operators.features import CATEGORIES, NUMERIC_FEATURES, TARGET
from riskweave.session import ship

MAX_LEVELS = 1000
DIGIT = 12  # bits that one pass over the values tells apart
_LARGEST = (1 << 63) - 1


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column, ignoring nulls: rows (column, median), selected by digits.

    A double is read as a 64-bit number of the same order. A pass counts, within the values that
    share the digits known so far, how many have each next digit, with their least and greatest value; the digit that holds the wanted
    rank is kept, until all values behind it are one. Nothing is shuffled but these counts, at most ``2 ** DIGIT`` per column and pass, and the number
    of passes is bounded by the bits of a double.
    """
    ship(df.sparkSession)
    known = list(columns)
    doubles = df.select([F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(known)])
    # What is sought: (column, rank within the values that begin with the prefix, prefix, bits known).
    sought: dict[tuple[int, bool], tuple[int, int, int]] = {}
    values: dict[tuple[int, bool], float] = {}
    cells = {(i, 0, 0) for i in range(len(known))}
    while cells:
        counted: dict[tuple[int, int, int], list[tuple[int, int, int, int]]] = {}
        for r in _digits(doubles, cells).collect():  # at most 2 ** DIGIT rows a cell
            counted.setdefault((r.at, r.prefix, r.bits), []).append((r.digit, r.n, r.low, r.high))
        if not sought:
            for i in range(len(known)):
                n = sum(d[1] for d in counted.get((i, 0, 0), ()))
                sought |= {(i, False): ((n - 1) // 2, 0, 0), (i, True): (n // 2, 0, 0)} if n else {}
        for key, (rank, prefix, bits) in list(sought.items()):
            for digit, n, low, high in sorted(counted[key[0], prefix, bits]):
                if rank < n:
                    break
                rank -= n
            if low == high:
                values[key] = of_image(low)
                del sought[key]
            else:
                sought[key] = (rank, (prefix << DIGIT) | digit, bits + DIGIT)
        cells = {(i, prefix, bits) for (i, _), (_, prefix, bits) in sought.items()}
    halfway = lambda i: values[i, False] + (values[i, True] - values[i, False]) * 0.5
    rows = [(c, halfway(i)) for i, c in enumerate(known) if (i, False) in values]
    return df.sparkSession.createDataFrame(rows, "column string, median double")


def ordered_image(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one, and NaN is one value after all others."""
    raw = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(_LARGEST), raw)


def of_image(image: int) -> float:
    return float(np.int64(image ^ _LARGEST if image < 0 else image).view(np.float64))


def _digits(doubles: DataFrame, cells: set[tuple[int, int, int]]) -> DataFrame:
    """(at, prefix, bits, digit, n, low, high): the images of a column that begin with a prefix, by their next digit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[np.ndarray]] = {c: [] for c in cells}
        for b in batches:
            for at in sorted({c[0] for c in cells}):
                image = ordered_image(b.column(at).drop_null().to_numpy(zero_copy_only=False))
                raised = image.view(np.uint64) ^ np.uint64(1 << 63)
                for cell in (c for c in cells if c[0] == at):
                    _, prefix, bits = cell
                    live = np.flatnonzero(raised >> np.uint64(64 - bits) == np.uint64(prefix)) if bits else np.arange(len(image))
                    width = min(DIGIT, 64 - bits)
                    digit = ((raised[live] >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    held[cell].append(_by_digit(digit, np.ones(len(live), np.int64), image[live], image[live]))
        for (at, prefix, bits), parts in held.items():
            if parts:
                digit, n, low, high = _by_digit(*np.concatenate(parts, axis=1))
                same = [pa.array(np.full(len(digit), v, np.int64)) for v in (at, prefix, bits)]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (digit, n, low, high))], ["at", "prefix", "bits", "digit", "n", "low", "high"])

    parts = doubles.mapInArrow(run, "at long, prefix long, bits long, digit long, n long, low long, high long")
    return parts.groupBy("at", "prefix", "bits", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _by_digit(digit: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (digit, count, least, greatest), one column per digit."""
    order = np.argsort(digit, kind="stable")
    begins = np.flatnonzero(np.append(True, digit[order][1:] != digit[order][:-1])) if len(digit) else np.empty(0, np.int64)
    if not len(begins):
        return np.empty((4, 0), np.int64)
    return np.stack([digit[order][begins], np.add.reduceat(n[order], begins), np.minimum.reduceat(low[order], begins), np.maximum.reduceat(high[order], begins)])


def category_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted known levels per column; a column with too many levels is an error."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull()).distinct()
    rows = seen.limit(max_levels * len(columns) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        levels[r.c].append(r.v)
    crowded = [c for c, v in levels.items() if len(v) > max_levels]
    if crowded or len(rows) > max_levels * len(columns):
        raise ValueError(f"too many levels to one-hot encode: {crowded or list(columns)}")
    return {c: sorted(v) for c, v in levels.items()}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Encoding:
    """Fitted feature list. ``stages`` are ordinary pipeline stages that save and load."""

    medians: dict[str, float]
    levels: dict[str, list[str]]

    @property
    def one_hot(self) -> dict[str, str]:
        """Feature name -> SQL. The first level is left out; null has its own column."""
        out = {}
        for c, levels in self.levels.items():
            for level in levels[1:]:
                out[f"{c}_{level}"] = f"CASE WHEN CAST(`{c}` AS STRING) = {_quoted(level)} THEN 1D ELSE 0D END"
            out[f"{c}_nan"] = f"CASE WHEN `{c}` IS NULL THEN 1D ELSE 0D END"
        return out

    @property
    def names(self) -> list[str]:
        return [*self.medians, *self.one_hot]

    def stages(self, output: str = "features") -> list:
        filled = {c: f"COALESCE(CAST(`{c}` AS DOUBLE), {float(m)!r}D)" for c, m in self.medians.items()}
        exprs = ", ".join(f"{sql} AS `x_{name}`" for name, sql in {**filled, **self.one_hot}.items())
        select = SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")
        assemble = VectorAssembler(inputCols=[f"x_{n}" for n in self.names], outputCol=output)
        drop = ", ".join(f"`x_{n}`" for n in self.names)
        tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__")
        return [select, assemble, tidy]


def fit_encoding(
    train: DataFrame,
    numeric: Sequence[str] = tuple(NUMERIC_FEATURES),
    categories: Sequence[str] = tuple(CATEGORIES),
    sensitive_as_features: bool = False,
    max_levels: int = MAX_LEVELS,
) -> Encoding:
    """Medians and levels from training rows only; more than ``max_levels`` levels are an error.

    Race, marital status and sex stay out of the features unless asked for; they
    remain columns for auditing either way.
    """
    medians = {r["column"]: r["median"] for r in column_medians(train, numeric).collect()}
    levels = category_levels(train, categories, max_levels) if sensitive_as_features and categories else {}
    return Encoding({c: medians.get(c, 0.0) for c in numeric}, levels)


def balance_weights(df: DataFrame, label: str = TARGET, out: str = "weight") -> DataFrame:
    """Add n / (classes * n_class); the two class counts are a scalar subquery."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    weights = counts.select(
        F.struct(
            F.try_divide(F.col("n"), 2 * F.col("p")).alias("one"),
            F.try_divide(F.col("n"), 2 * (F.col("n") - F.col("p"))).alias("zero"),
        )
    ).scalar()
    weighted = df.withColumn("__w", weights)
    chosen = F.when(F.col(label) == 1, F.col("__w.one")).otherwise(F.col("__w.zero"))
    return weighted.withColumn(out, chosen).drop("__w")
