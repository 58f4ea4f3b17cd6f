"""Logistic regressions of many fits at once by Newton steps.

Every step is one scan of the rows and one aggregate: tasks add up X'WX, X'r and the loss of each fit at its own
coefficients, the sums meet by fit, and the driver solves systems of the number of features. Folds and groups
cost the scans of one fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

TOLERANCE = 1e-9
ROWS_AT_ONCE = 8192


@dataclass
class Linear:
    """``coefficients`` of standardised features; a feature that does not vary has none."""

    coefficients: np.ndarray
    intercept: float
    mean: np.ndarray
    deviation: np.ndarray
    steps: int = 0

    @property
    def slopes(self) -> np.ndarray:
        """Per unit of the raw features."""
        return self.coefficients / self.deviation

    @property
    def offset(self) -> float:
        return float(self.intercept - self.slopes @ self.mean)


def _sums(tagged: DataFrame, fits: int, part: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum over all rows of ``part(x, y, fit)`` for every fit with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                some = b.slice(at, ROWS_AT_ONCE)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                y = some.column(1).to_numpy().astype(float)
                of = np.repeat(np.arange(some.num_rows), np.asarray(some.column(2).value_lengths()))
                member = some.column(2).flatten().to_numpy()
                for f in range(fits):
                    rows = of[member == f]
                    if len(rows):
                        found = part(x[rows], y[rows], f)
                        total[f] = total[f] + found if f in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["fit", "part"])

    parts = tagged.mapInArrow(run, "fit int, part array<double>").select("fit", array_to_vector("part").alias("part"))
    found = parts.groupBy("fit").agg(Summarizer.sum(F.col("part")).alias("s")).select("fit", vector_to_array("s").alias("s")).collect()
    return {r.fit: np.array(r.s) for r in found}


def fit_logistics(
    rows: DataFrame, label: str, fits: Sequence[Column], c: float, features: str = "features", balance: bool = True,
    standardise: bool = True, iterations: int = 100,
) -> list[Linear]:
    """One regression per fit, with a ridge penalty of strength 1 / ``c`` on the summed loss; the intercept is free.

    ``balance`` gives each class of a fit half of its weight. ``rows`` are read once per step: they should be written.
    """
    member = F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)]))
    tagged = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), member.alias("m"))
    first = _sums(tagged, len(fits), lambda x, y, f: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    if len(first) < len(fits):
        raise ValueError("a logistic fit has no rows")
    n, ones = (np.array([first[f][i] for f in range(len(fits))]) for i in (0, 1))
    mean = np.stack([first[f][2:] / n[f] for f in range(len(fits))])
    width = mean.shape[1]
    if standardise:
        second = _sums(tagged, len(fits), lambda x, y, f: ((x - mean[f]) ** 2).sum(axis=0))
        deviation = np.stack([np.sqrt(second[f] / n[f]) for f in range(len(fits))])
        deviation[deviation <= 1e-12 * (1 + np.abs(mean))] = np.inf
    else:
        mean, deviation = np.zeros_like(mean), np.ones_like(mean)
    weights = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], axis=1) if balance else np.ones((len(fits), 2))
    beta, step = np.zeros((len(fits), width + 1)), np.zeros((len(fits), width + 1))
    ridge = np.append(np.full(width, 1 / c), 0.0)
    best, steps = np.full(len(fits), np.inf), np.zeros(len(fits), dtype=int)
    open_fits = np.ones(len(fits), dtype=bool)

    def terms(x: np.ndarray, y: np.ndarray, f: int) -> np.ndarray:
        if not open_fits[f]:
            return np.zeros(1)
        z = np.column_stack([(x - mean[f]) / deviation[f], np.ones(len(y))])
        w, eta = weights[f, y.astype(int)], z @ beta[f]
        p = 1 / (1 + np.exp(-eta))
        loss = (w * (np.logaddexp(0, eta) - y * eta)).sum()
        return np.concatenate([[loss], z.T @ (w * (y - p)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()])

    for _ in range(iterations):
        sums = _sums(tagged, len(fits), terms)
        for f in np.flatnonzero(open_fits):
            loss = sums[f][0] + 0.5 * (ridge * beta[f] ** 2).sum()
            if loss > best[f] + 1e-9 * abs(best[f]):
                # Too far: half of the last step is taken back.
                step[f] /= 2
                beta[f] -= step[f]
                open_fits[f] = np.abs(step[f]).max() > TOLERANCE
                continue
            best[f] = loss
            gradient = sums[f][1 : width + 2] - ridge * beta[f]
            curve = sums[f][width + 2 :].reshape(width + 1, width + 1) + np.diag(ridge)
            # A feature without variance, or a fit of one class, leaves directions without curve.
            step[f] = np.linalg.lstsq(curve, gradient, rcond=1e-14)[0]
            beta[f] += step[f]
            steps[f] += 1
            open_fits[f] = np.abs(step[f]).max() > TOLERANCE * (1 + np.abs(beta[f]).max())
        if not open_fits.any():
            break
    return [Linear(beta[f, :-1], float(beta[f, -1]), mean[f], deviation[f], int(steps[f])) for f in range(len(fits))]
