"""Patient archetypes: scale, project, cluster, profile, and use clusters in models.

All restarts of the clustering run together: one scan and one aggregate per iteration, its sums keyed by
(restart, cluster). Seeds are found by oversampling, likewise for all restarts at once; which rows are drawn follows from a hash of
their values, so that a task that runs twice draws the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from riskweave.operators.features import TARGET
from riskweave.operators.fitted import FittedCentres
from riskweave.session import materialise, ship

# Number of clusters, projection size, restarts, and the columns profiled.
CLUSTERS = 4
COMPONENTS = 20
RESTARTS = 10
MAX_ITERATIONS = 300
TOLERANCE = 1e-4  # of the mean variance, by which centres may still move
SEED_ROUNDS = 3
ROWS_AT_ONCE = 8192
PROFILE_COLUMNS = [
    "flag_glaucoma", "flag_diabetes", "flag_glaucoma_diabetic", "flag_ckd", "flag_hf", "flag_hypertension",
    "flag_depression", "ADINatrank", "CAHPIPercentile", "last_12months_officevisit_count", "last_12months_chronic_count",
]


@dataclass
class Archetypes:
    """Fitted clustering; cluster numbers run from the largest cluster down."""

    model: PipelineModel
    order: tuple[int, ...]  # new number of each raw cluster
    cost: float

    @property
    def k(self) -> int:
        return len(self.order)

    def assign(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        """Nearest centre of each row; centres travel with the model, rows stay where they are."""
        placed = self.model.transform(df)
        number = F.element_at(F.array(*[F.lit(i) for i in self.order]), F.col("__raw") + 1)
        return placed.withColumn(out, number).drop("__std", "__pca", "__raw")


def _sums(points: DataFrame, part: Callable[[np.ndarray], dict[tuple[int, int], np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """Sums of ``part(x)`` by its keys over all rows, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for at in range(0, len(x), ROWS_AT_ONCE):
                for key, found in part(x[at : at + ROWS_AT_ONCE]).items():
                    total[key] = total[key] + found if key in total else found
        if total:
            one, two = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["one", "two", "part"])

    parts = points.mapInArrow(run, "one int, two int, part array<double>").select("one", "two", array_to_vector("part").alias("part"))
    found = parts.groupBy("one", "two").agg(Summarizer.sum(F.col("part")).alias("s")).select("one", "two", vector_to_array("s").alias("s")).collect()
    return {(r.one, r.two): np.array(r.s) for r in found}


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, centres) squared distances."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, 0.0)


def _drawn(x: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for every row, by its values."""
    h = np.full(len(x), salt + 1, dtype=np.uint64)
    for column in (np.ascontiguousarray(x.T) + 0.0).view(np.uint64):
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def seeds(points: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """(restarts, k, width) first centres: rows drawn in rounds by their squared distance to those drawn before, then thinned by weight.

    About 2 k rows are drawn per round and restart, so that the driver holds a bounded number of them.
    """
    first = _sums_of_least(points, restarts, seed)
    chosen = [[first[r]] for r in range(restarts)]
    for number in range(SEED_ROUNDS):
        held = [np.array(c) for c in chosen]
        cost = {r: v[0] for (r, _), v in _sums(points, lambda x, held=held: {(r, 0): np.array([squared(x, c).min(axis=1).sum()]) for r, c in enumerate(held)}).items()}

        def draw(batches: Iterator[pa.RecordBatch], held: list = held, cost: dict = cost, number: int = number) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                for r, c in enumerate(held):
                    if cost.get(r, 0) > 0:
                        near = squared(x, c).min(axis=1)
                        taken = np.flatnonzero((near > 0) & (_drawn(x, (seed + r) * 1000 + number) < 2 * k * near / cost[r]))
                        if len(taken):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(taken), r, np.int32)), pa.array(list(x[taken]), pa.list_(pa.float64()))], ["restart", "x"])

        # Equal rows draw alike: a crowd of copies is one candidate.
        for r in points.mapInArrow(draw, "restart int, x array<double>").distinct().collect():
            chosen[r.restart].append(np.array(r.x))
    held = [np.array(sorted(c, key=tuple)) for c in chosen]

    def nearest(x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        return {(r, c): np.array([float(n)]) for r, centres in enumerate(held) for c, n in enumerate(np.bincount(squared(x, centres).argmin(axis=1), minlength=len(centres))) if n}

    weights = _sums(points, nearest)
    out = []
    for r, centres in enumerate(held):
        weight = np.array([weights.get((r, c), np.zeros(1))[0] for c in range(len(centres))])
        rng = np.random.default_rng(seed + r)
        kept = [int(rng.choice(len(centres), p=weight / weight.sum()))]
        while len(kept) < k:
            far = weight * squared(centres, centres[kept]).min(axis=1)
            # Fewer distinct rows than centres: some centres are equal, and stay empty.
            kept.append(int(rng.choice(len(centres), p=far / far.sum())) if far.sum() > 0 else kept[0])
        out.append(centres[kept])
    return np.array(out)


def _sums_of_least(points: DataFrame, restarts: int, seed: int) -> list[np.ndarray]:
    """For each restart the row of the smallest number drawn."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, np.ndarray]] = {}
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for r in range(restarts if len(x) else 0):
                u = _drawn(x, (seed + r) * 1000 + 999)
                at = int(np.argmin(u))
                if r not in best or (u[at], *x[at]) < (best[r][0], *best[r][1]):
                    best[r] = (float(u[at]), x[at])
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()]), pa.array([v[1] for v in best.values()], pa.list_(pa.float64()))], ["r", "u", "x"]
            )

    found = points.mapInArrow(least, "r int, u double, x array<double>").groupBy("r").agg(F.min(F.struct("u", "x")).alias("b")).collect()
    return [np.array(row.b.x) for row in sorted(found, key=lambda row: row.r)]


def lloyd_sums(points: DataFrame, centres: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(restart, cluster) to rows, cost and sums of the rows nearest to that centre; ``centres``: (restarts, k, width)."""

    def part(x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for r, mine in enumerate(centres):
            d = squared(x, mine)
            near = d.argmin(axis=1)
            cost = np.bincount(near, d[np.arange(len(x)), near], minlength=len(mine))
            for c, n in enumerate(np.bincount(near, minlength=len(mine))):
                if n:
                    out[r, c] = np.concatenate([[n, cost[c]], x[near == c].sum(axis=0)])
        return out

    return _sums(points, part)


@dataclass
class Clustering:
    centres: np.ndarray
    sizes: np.ndarray
    cost: float
    scans: int


def fit_centres(points: DataFrame, k: int, restarts: int, max_iterations: int = MAX_ITERATIONS, seed: int = 42) -> Clustering:
    """The best of all restarts by cost. ``points`` is a written table with one array column."""
    ship(points.sparkSession)
    centres = seeds(points, k, restarts, seed)
    open_runs, best, scans, allowed = np.arange(restarts), None, 0, None
    while True:
        sums = lloyd_sums(points, centres[open_runs])
        scans += 1
        if allowed is None:
            every = [v for (r, _), v in sums.items() if r == 0]
            n, total = sum(v[0] for v in every), sum(v[2:] for v in every)
            spread = _sums(points, lambda x: {(0, 0): ((x - total / n) ** 2).sum(axis=0)})[0, 0]
            allowed = TOLERANCE * float(np.mean(spread / n))
        still = []
        for i, r in enumerate(open_runs):
            found = {c: v for (run, c), v in sums.items() if run == i}
            moved = centres[r].copy()
            for c, v in found.items():
                moved[c] = v[2:] / v[0]
            cost, sizes = sum(v[1] for v in found.values()), np.array([found[c][0] if c in found else 0 for c in range(k)])
            if best is None or cost < best.cost:
                best = Clustering(centres[r].copy(), sizes, float(cost), scans)
            if ((moved - centres[r]) ** 2).sum() > allowed:
                still.append(r)
            centres[r] = moved
        open_runs = np.array(still, dtype=np.int64)
        if not len(open_runs) or scans > max_iterations:
            best.scans = scans
            return best


def fit_archetypes(
    prepared: DataFrame, k: int = CLUSTERS, components: int = COMPONENTS, restarts: int = RESTARTS,
    max_iterations: int = MAX_ITERATIONS, seed: int = 42,
) -> Archetypes:
    """Best of several restarts by training cost, over standardised principal components."""
    vectors = prepared.select("features")
    width = len(vectors.first()["features"])
    scaler = StandardScaler(inputCol="features", outputCol="__std", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors)
    pca = PCA(k=min(components, width), inputCol="__std", outputCol="__pca").fit(scaled)
    points = materialise(pca.transform(scaled).select(vector_to_array("__pca").alias("x")), "projected")
    found = fit_centres(points, k, restarts, max_iterations, seed)
    by_size = sorted(range(k), key=lambda c: (-found.sizes[c], c))
    order = tuple(by_size.index(c) for c in range(k))
    model = FittedCentres.of(found.centres, "__pca", "__raw")
    return Archetypes(PipelineModel([scaler, pca, model]), order, found.cost)


def cluster_sizes(assigned: DataFrame, split: str = "split", target: str = TARGET) -> DataFrame:
    """Rows and positive rate per cluster in training and validation, side by side."""
    wide = assigned.groupBy("cluster").pivot(split, ["train", "val"]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate")
    )
    return wide.select(
        "cluster",
        F.coalesce("train_n", F.lit(0)).alias("n_train"), F.coalesce("val_n", F.lit(0)).alias("n_val"),
        F.col("train_rate").alias("train_pos_rate"), F.col("val_rate").alias("val_pos_rate"),
    )


def cluster_means(assigned: DataFrame, columns: Sequence[str] = tuple(PROFILE_COLUMNS)) -> DataFrame:
    """Mean of each profile column per cluster, one row per (column, cluster)."""
    present = [c for c in columns if c in assigned.columns]
    means = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in present])
    return means.unpivot("cluster", present, "feature", "mean")


def with_indicators(assigned: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """Append one 0/1 entry per cluster to the feature vector."""
    flags = [f"cluster_{i}" for i in range(k)]
    tagged = assigned.withColumns({f: (F.col("cluster") == i).cast("double") for i, f in enumerate(flags)})
    tagged = tagged.withColumnRenamed("features", "__base")
    return VectorAssembler(inputCols=["__base", *flags], outputCol="features").transform(tagged).drop("__base", *flags)


def cluster_verdict(delta: Column) -> Column:
    """Whether clusters as features pay off."""
    return F.when(delta > 0.01, "adopt").when(delta > 0, "marginal").otherwise("no gain")
