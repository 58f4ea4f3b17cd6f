"""Approximate nearest neighbours by multi-probe p-stable hashing.

Each of several tables hashes a vector by ``floor((a . v + b) / w)`` for a few Gaussian
directions ``a``. A query looks into its own bucket of every table and into neighbouring
buckets, in the order of their estimated success: a step over the nearer boundary of a
direction costs its squared distance, and sets of steps are taken in order of total cost.
The candidates of all tables are merged and reranked by exact distance.

Equal vectors are one entry of the index with their smallest ids, as many as any answer can
need, so a vector that a third of all rows share costs one entry. Width, directions and their
number are fitted on a bounded sample (``SAMPLE``) so that its own neighbours are found with
``RECALL``; in the whole table neighbours are nearer, and found more often. Every row is indexed.

The queries go over the index in blocks: the probed buckets of a block (``BLOCK_BYTES`` at most)
are sent to all tasks, each of which merges the candidates of all tables for the entries it
holds, computes their exact distances and keeps its own best. No vector is shuffled, and a
crowded bucket is spread over the tasks that hold it. A query with too few candidates is
answered by a scan of all entries, likewise in blocks.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do
those of another length than the fitted one (the most frequent in the sample, ties to the
longer). Ties in distance go to the smaller id. Rows of equal id and vector count once, and a
query never finds rows of its own id; rows with a null id are never found. With fewer than k others all are returned. An
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskweave.llm.common import mix64, table
from riskweave.session import materialise

SAMPLE = 2_000
TABLES = 24
PROBES = 100
RECALL = 0.93  # on the sample, where neighbours are farther apart
BLOCK_BYTES = 32 << 20
K = 10


@dataclass
class Hashes:
    """``directions``: (tables, per table, length); ``offsets``: (tables, per table)."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, per table), in units of the width."""
        return (np.einsum("rd,tmd->rtm", vectors, self.directions) + self.offsets) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit key for each (row, table) of integer cells."""
        h = np.zeros(cells.shape[:2], dtype=np.uint64)
        for m in range(cells.shape[2]):
            h = mix64(h + np.uint64(0x9E3779B97F4A7C15)) + cells[:, :, m].astype(np.int64).view(np.uint64)
        return mix64(h)


def probe_sets(costs: list[float], n: int) -> list[tuple[int, ...]]:
    """The ``n`` cheapest sets of steps (indices into sorted costs), without the empty set.

    The two steps of a direction stand at mirrored places of the sorted list, so a set that
    holds both places of a pair is not valid. The heap grows sets by shifting and extending.
    """
    order = sorted(range(len(costs)), key=costs.__getitem__)
    out: list[tuple[int, ...]] = []
    heap = [(costs[order[0]], (0,))]
    while heap and len(out) < n:
        cost, chosen = heapq.heappop(heap)
        steps = tuple(order[i] for i in chosen)
        if len({s >> 1 for s in steps}) == len(steps):
            out.append(steps)
        last = chosen[-1] + 1
        if last < len(order):
            step = costs[order[last]]
            heapq.heappush(heap, (cost + step, (*chosen, last)))
            heapq.heappush(heap, (cost + step - costs[order[chosen[-1]]], (*chosen[:-1], last)))
    return out


def probes(hashes: Hashes, vectors: np.ndarray, n: int) -> np.ndarray:
    """Keys of (rows, tables, 1 + n) buckets: the own one, then in order of estimated success."""
    places = hashes.places(vectors)
    cells = np.floor(places)
    inside = places - cells
    out = np.empty((*cells.shape[:2], n + 1), dtype=np.uint64)
    out[:, :, 0] = hashes.keys(cells)
    moved = np.repeat(cells[:, :, None, :], n, axis=2)
    for r in range(cells.shape[0]):
        for t in range(cells.shape[1]):
            x = inside[r, t]
            costs = np.stack([x**2, (1 - x) ** 2], axis=1).ravel().tolist()
            sets = probe_sets(costs, n)
            for p in range(n):
                for s in sets[min(p, len(sets) - 1)]:
                    moved[r, t, p, s >> 1] += 1 if s & 1 else -1
    for p in range(n):
        out[:, :, p + 1] = hashes.keys(moved[:, :, p, :])
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        .filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    )


def _recall(hashes: Hashes, points: np.ndarray, queries: np.ndarray, near: np.ndarray, n_probes: int) -> float:
    keys = hashes.keys(np.floor(hashes.places(points)))
    looked = probes(hashes, points[queries], n_probes)
    hits = [any(keys[j, t] in looked[i, t] for t in range(keys.shape[1])) for i in range(len(queries)) for j in near[i]]
    return float(np.mean(hits))


def fit(
    entries: DataFrame, sample: int = SAMPLE, tables: int = TABLES, n_probes: int = PROBES, k: int = K, recall: float = RECALL, seed: int = 11
) -> Hashes | None:
    """Width, directions and their number from at most ``sample`` entries."""
    rows = entries.orderBy(F.xxhash64("first_id", "v"), "first_id").select("v").limit(sample).toArrow().column("v").to_pylist()
    if not rows:
        return None
    sizes = [len(r) for r in rows]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    points = np.array([r for r in rows if len(r) == size])
    rng = np.random.default_rng(seed)
    queries = np.arange(min(len(points), 48))
    squared = (points[queries] ** 2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * points[queries] @ points.T
    squared[queries, queries] = np.inf
    near = np.argsort(squared, axis=1)[:, : max(1, min(k, len(points) - 1))]
    gaps = np.sqrt(np.maximum(np.take_along_axis(squared, near, axis=1), 0))
    typical = float(np.median(gaps[:, min(3, gaps.shape[1] - 1)])) if len(points) > 1 else 1.0
    width = 2.0 * typical or 1.0
    most = 24
    directions, offsets = rng.normal(size=(tables, most, size)), rng.uniform(0, width, (tables, most))
    cut = lambda m: Hashes(directions[:, :m], offsets[:, :m], width)
    # The more directions, the fewer candidates: as many as the wanted recall allows.
    low, high = 1, most
    while len(points) > 1 and low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _recall(cut(middle), points, queries, near, n_probes) >= recall else (low, middle - 1)
    return cut(low if len(points) > 1 else 4)


def _collapse(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: v, its smallest ids, and the smallest of them."""

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Within a task a vector keeps its smallest ids only, before anything is shuffled.
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            vectors = [np.frombuffer(k, dtype=np.float64) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array([sorted(set(held[k]))[:keep] for k in keys], pa.list_(pa.int64()))], ["v", "ids"])

        for b in batches:
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1)):
                ids = held.setdefault((np.asarray(v.values, dtype=np.float64) + 0.0).tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
            if len(held) > 100_000:
                yield out()
                held.clear()
        if held:
            yield out()

    small = rows.filter("vec_id is not null").mapInArrow(fewer, "v array<double>, ids array<long>")
    merged = small.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    return merged.withColumn("first_id", F.element_at("ids", 1))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each query; ranks are cut within tasks before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("score", *by)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _answers(near: DataFrame, k: int) -> DataFrame:
    """From the nearest entries of each query to its nearest rows, itself left out."""
    each = near.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    return _best(each, ["vec_id"], k).select("query_id", "rank", "vec_id", "score")


_FOUND = "query_id long, first_id long, ids array<long>, score double"


def _nearest(first: np.ndarray, ids: pa.Array, at: np.ndarray, query_id: int, d: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of the entries ``at`` (distances ``d``) as rows."""
    if len(d) > 4 * k:
        least = np.partition(d, k - 1)[k - 1]
        at, d = at[d <= least], d[d <= least]
    best = np.lexsort((first[at], d))[:k]
    take = at[best]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query_id)), pa.array(first[take]), ids.take(pa.array(take)), pa.array(d[best])], ["query_id", "first_id", "ids", "score"])


def _rerank(index: DataFrame, block: list[tuple], k: int, n_tables: int) -> DataFrame:
    """Nearest entries of a block of queries (id, vector, probed keys), from the buckets they probe.

    Without keys, every entry is a candidate.
    """
    sent = index.sparkSession.sparkContext.broadcast([(q, np.frombuffer(v), keys and np.frombuffer(keys, np.uint64).reshape(n_tables, -1)) for q, v, keys in block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for b in batches:
            first, ids, n = b.column(0).to_numpy(), b.column(1), b.num_rows
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            own = b.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)
            # Each table once in order of its keys: a probed bucket is then one run.
            orders = np.argsort(own, axis=0, kind="stable")
            ranked = np.take_along_axis(own, orders, axis=0)
            for query_id, v, keys in queries:
                mark = np.full(n, keys is None)
                for t in range(n_tables if keys is not None else 0):
                    low, high = np.searchsorted(ranked[:, t], keys[t]), np.searchsorted(ranked[:, t], keys[t], "right")
                    for i in np.flatnonzero(high > low):
                        mark[orders[low[i] : high[i], t]] = True
                at = np.flatnonzero(mark)
                if len(at):
                    yield _nearest(first, ids, at, query_id, np.sqrt(((x[at] - v) ** 2).sum(axis=1)), k)

    return _best(index.select("first_id", "ids", "v", "keys").mapInArrow(run, _FOUND), ["first_id"], k)


def _in_blocks(index: DataFrame, queries: DataFrame, k: int, n_tables: int) -> DataFrame | None:
    """Answers to all queries (query_id, qv, keys), a bounded block of them at a time."""
    out, block, held = None, [], 0

    def close(out: DataFrame | None) -> DataFrame:
        part = materialise(_answers(_rerank(index, block, k + 1, n_tables), k), "neighbours")
        return part if out is None else out.unionByName(part)

    for row in queries.toLocalIterator():
        block.append((row.query_id, bytes(row.qv), row["keys"] and bytes(row["keys"])))
        held += len(row.qv) + len(row["keys"] or b"")
        if held >= BLOCK_BYTES:
            out, block, held = close(out), [], 0
    return close(out) if block else out


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
    tables: int = TABLES, n_probes: int = PROBES, sample: int = SAMPLE, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row that ``is_query`` picks."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A query's own copies are an entry too, so k + 1 ids of an entry are enough.
    entries = materialise(_collapse(rows, k + 1), "vector-entries")
    hashes = fit(entries, sample, tables, n_probes, k, recall)
    if hashes is None:
        return empty
    size = hashes.directions.shape[2]
    shared = spark.sparkContext.broadcast(hashes)

    def add_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            keys = shared.value.keys(np.floor(shared.value.places(x))).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["first_id", "ids", "v", "keys"])

    def add_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                keys = probes(shared.value, x, n_probes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x]), pa.array([key.tobytes() for key in keys])], ["query_id", "qv", "keys"])

    fits = F.size("v") == size
    index = materialise(entries.filter(fits).select("first_id", "ids", "v").mapInArrow(add_keys, "first_id long, ids array<long>, v array<double>, keys array<long>"), "vector-index")
    asked = usable(vectors.filter(is_query), id_col, vec_col).filter(fits & F.col("vec_id").isNotNull()).dropDuplicates()
    # Probing costs far more than reading a query: the few rows are spread over all tasks.
    asked = asked.repartition(spark.sparkContext.defaultParallelism)
    queries = materialise(asked.mapInArrow(add_probes, "query_id long, qv binary, keys binary"), "probes")
    found = _in_blocks(index, queries, k, tables)
    if found is None:
        return empty

    # Queries that the buckets gave too few rows are scanned for.
    others = index.select(F.explode("ids")).limit(k + 1).count() - 1
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, others))
    short = materialise(queries.join(full, "query_id", "left_anti").select("query_id", "qv", F.lit(None).cast("binary").alias("keys")), "short-queries")
    scanned = _in_blocks(index, short, k, tables)
    if scanned is None:
        return found
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(scanned)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
