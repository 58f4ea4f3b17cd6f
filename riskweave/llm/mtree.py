"""Exact top-k search by inner product: an M-tree, best first.

Inner products become distances: with ``M`` the largest norm, a vector x gets one more component
sqrt(M^2 - |x|^2) and a query q a zero, so that |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. The nearest are the highest.

The tree has three levels of metric nodes, each with a routing vector, a covering radius and its distance to
the parent's routing vector:

- regions around routing vectors that are drawn from a bounded sample (``SAMPLE``); every entry goes to the
  nearest. A region's radius is an aggregate over all its entries. Regions number at most ``MOST_REGIONS``; their
  table is all that is broadcast.
- subtrees: a region of more than ``SUBTREE`` entries is dealt out by a hash among several, so that a task holds a bounded one at a time.
- pages of up to ``PAGE`` entries, split in two between far-apart entries until they are small. Each entry
  is stored with its distance to the page's routing vector.

A query visits regions in order of their best possible score, in rounds of ``ROUNDS`` regions; after each round its k-th score so far
closes the regions that cannot reach it, and the last round visits all that are left. In a subtree, pages
whose stored parent distance already rules them out cost no distance, the others are visited best
first, and a page's entries are ruled out by their own stored distance before any product is computed. A bound closes a node only
if it falls short by more than the rounding error of doubles, and ties are kept, so the answer is exact.

Queries and subtrees meet by subtree: a task holds one subtree and the queries stream past it. Equal vectors are
one entry with as many smallest ids as an answer can need, so copies cost nothing.

Components are scaled and rounded down to integers, and products are exact integers: in doubles while M^2 stays under 2^53,
with unbounded integers beyond; scores past a long are cut to its ends before they are compared.

Cases: null vectors and those with null or non-finite components (after scaling) take no part; zero vectors do. Vectors
of different length meet as if the shorter were filled with zeros. Ties in score go to the smaller id. Rows of equal id and vector count
once; several vectors of one query id are queries of their own, and a query never finds rows of its own id. Rows with a null id are never found and ask
nothing. With fewer than k others all are returned. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskweave.llm.common import ship, table
from riskweave.llm.neighbours import _collapse
from riskweave.session import materialise

SCALE = 1024
K = 10
SAMPLE = 8192  # entries that routing vectors are drawn from
REGION = 2048  # entries of a region, as wanted
MOST_REGIONS = 4096
MOST_BYTES = 16 << 20  # of the broadcast regions
SUBTREE = 4096  # entries of a subtree, about
PAGE = 128
ROUNDS = (1, 6)
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_SLACK = 1e-9


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer-valued doubles of the rows that take part."""
    # Doubles past 2^52 are whole already and may not fit a long.
    down = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("raw"))
    times = F.transform("raw", lambda x: x * F.lit(float(scale)))
    kept = rows.filter("vec_id is not null and raw is not null").select("vec_id", times.alias("v")).filter(~odd)
    return kept.select("vec_id", F.transform("v", down).alias("v"))


@dataclass
class Space:
    """Length of the padded vectors and the square of the largest norm."""

    size: int
    top: float

    def pad(self, lists: pa.ListArray) -> np.ndarray:
        sizes = np.asarray(lists.value_lengths())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes == self.size).all():
            return flat.reshape(len(sizes), self.size)
        out = np.zeros((len(sizes), self.size))
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Entries with their last component, which gives all of them the largest norm."""
        with np.errstate(all="ignore"):
            return np.column_stack([x, np.sqrt(np.maximum(self.top - (x**2).sum(axis=1), 0))])

    def most(self, q: np.ndarray, least: np.ndarray | float) -> np.ndarray | float:
        """The highest score of an entry at least so far from the query, and no less by rounding."""
        with np.errstate(all="ignore"):
            both = float(q @ q) + self.top
            return (both - np.maximum(least, 0) ** 2) / 2 + _SLACK * both

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.top < EXACT:
            return (x @ q).astype(np.int64)
        whole = [int(c) for c in q]
        return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], dtype=np.int64)


def gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances from ``c``, by differences: near ones are as exact as far ones."""
    with np.errstate(all="ignore"):
        return np.sqrt(((x - c) ** 2).sum(axis=1))


@dataclass
class Page:
    centre: np.ndarray
    radius: float
    parent: float  # distance to the region's routing vector
    x: np.ndarray
    gap: np.ndarray  # distances of the entries to the page's routing vector
    counts: np.ndarray
    ids: np.ndarray


def split(x: np.ndarray, page: int = PAGE) -> list[np.ndarray]:
    """Places of the entries, page by page: each part is halved between two far-apart entries until it fits a page."""
    done, parts = [], [np.arange(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= page:
            done.append(part)
            continue
        here = x[part]
        one = int(np.argmax(gaps(here, here.mean(axis=0))))
        from_one = gaps(here, here[one])
        from_two = gaps(here, here[int(np.argmax(from_one))])
        near = from_one <= from_two
        if near.all() or not near.any():
            near = np.arange(len(part)) < len(part) // 2
        parts += [part[near], part[~near]]
    return done


def build(space: Space, x: np.ndarray, counts: np.ndarray, ids: np.ndarray, centre: np.ndarray, page: int = PAGE) -> list[Page]:
    """Pages of one subtree; its region's routing vector is ``centre``."""
    lifted = space.lifted(x)
    ends = np.cumsum(counts)
    pages = []
    for part in split(lifted, page):
        routing = lifted[part[int(np.argmin(gaps(lifted[part], lifted[part].mean(axis=0))))]]
        gap = gaps(lifted[part], routing)
        own = np.concatenate([ids[ends[i] - counts[i] : ends[i]] for i in part])
        pages.append(Page(routing, float(gap.max()), float(gaps(routing[None, :], centre)[0]), x[part], gap, counts[part], own))
    return pages


def search_pages(space: Space, pages: list[Page], q: np.ndarray, own: int, from_region: float, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, products computed): what the pages hold of the k best, of scores at or above ``floor``.

    ``from_region`` is the query's distance to the routing vector of the region.
    """
    scores, ids, computed = np.empty(0, np.int64), np.empty(0, np.int64), 0
    lifted = np.append(q, 0.0)
    radius, parent = np.array([p.radius for p in pages]), np.array([p.parent for p in pages])
    # Stored parent distances rule pages out before any distance is computed.
    live = np.flatnonzero(~(space.most(q, np.abs(from_region - parent) - radius) < floor))
    if not len(live):
        return scores, ids, computed
    away = gaps(np.stack([pages[i].centre for i in live]), lifted)
    bound = space.most(q, away - radius[live])
    for at in np.argsort(-bound, kind="stable"):
        if bound[at] < floor:
            break
        page = pages[live[at]]
        may = ~(space.most(q, np.abs(away[at] - page.gap)) < floor)
        if not may.any():
            continue
        computed += int(may.sum())
        each = np.zeros(len(may), dtype=np.int64)
        each[may] = space.products(page.x[may], q)
        take = np.repeat(may & ~(each < floor), page.counts)
        found = page.ids[take]
        scores = np.append(scores, np.repeat(each, page.counts)[take][found != own])
        ids = np.append(ids, found[found != own])
        if len(scores) >= k:
            best = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[best], ids[best]
            # At the lowest long, cut scores of any size tie.
            floor = float(scores[-1]) if scores[-1] > -_LONG - 1 else floor
    return scores, ids, computed


@dataclass
class Regions:
    centres: np.ndarray  # lifted routing vectors
    radius: np.ndarray
    subtrees: np.ndarray

    def visits(self, space: Space, q: np.ndarray, floor: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(regions, distances to them) of the places ``low`` to ``high`` in the query's order that may reach ``floor``."""
        away = gaps(self.centres, np.append(q, 0.0))
        bound = space.most(q, away - self.radius)
        order = np.argsort(-bound, kind="stable")[low:high]
        order = order[~(bound[order] < floor)]
        return order, away[order]


_PAGE_ROW = "region long, subtree long, ask long, query_id long, n1 double, n2 double, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary"
_NAMES = [c.split()[0] for c in _PAGE_ROW.split(", ")]


def plant(entries: DataFrame, region: int = REGION, subtree: int = SUBTREE, page: int = PAGE) -> tuple[Space, Regions, DataFrame] | None:
    """The tree over (v, ids, first_id): its space, its regions, and a written table of pages. None without entries."""
    spark = entries.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, size, top = entries.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return None
    space = Space(size, float(top))
    most = min(MOST_REGIONS, SAMPLE, max(1, MOST_BYTES // (8 * (size + 1))))
    wanted = max(1, min(most, n // region))
    drawn = entries.orderBy(F.xxhash64("first_id", "v"), "first_id").select("v").limit(wanted).toArrow().combine_chunks()
    centres = space.lifted(space.pad(drawn.column("v").combine_chunks() if drawn.num_rows else pa.array([[]])))
    sent = spark.sparkContext.broadcast((space, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, centres = sent.value
        for b in batches:
            lifted = space.lifted(space.pad(b.column(0)))
            # All entries have one norm: the nearest centre is the one of the highest product.
            with np.errstate(all="ignore"):
                near = np.concatenate([np.argmax(lifted[at : at + 1024] @ centres.T, axis=1) for at in range(0, len(lifted), 1024)] or [np.empty(0, np.int64)])
            gap = gaps(lifted, centres[near]) if len(lifted) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int64)), pa.array(gap)], [*b.schema.names, "region", "gap"])

    placed = entries.select("v", "ids", "first_id").mapInArrow(assign, "v array<double>, ids array<long>, first_id long, region long, gap double")
    placed = materialise(placed, "mtree-entries")
    found = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # a row per region
    radius, subtrees = np.full(len(centres), -np.inf), np.zeros(len(centres), dtype=np.int64)
    for r in found:
        radius[r.region], subtrees[r.region] = r.radius, -(-r.n // subtree)
    parts = spark.createDataFrame([(i, int(s)) for i, s in enumerate(subtrees)], "region long, parts long")
    dealt = placed.join(F.broadcast(parts), "region").withColumn("subtree", F.pmod(F.xxhash64("first_id", "v"), "parts"))

    def pages_of(group: pa.Table) -> pa.Table:
        space, centres = sent.value
        group = group.combine_chunks()
        region, number = group.column("region")[0].as_py(), group.column("subtree")[0].as_py()
        lists = group.column("ids").combine_chunks()
        x, counts, ids = space.pad(group.column("v").combine_chunks()), np.asarray(lists.value_lengths()), lists.flatten().to_numpy()
        rows = [
            (region, number, -1, -1, p.radius, p.parent, p.centre.tobytes(), p.x.tobytes(), p.gap.tobytes(), p.counts.astype(np.int64).tobytes(), p.ids.tobytes())
            for p in build(space, x, counts, ids, centres[region], page)
        ]
        return pa.table(dict(zip(_NAMES, (pa.array(c) for c in zip(*rows)))))

    pages = materialise(dealt.select("region", "subtree", "v", "ids").groupBy("region", "subtree").applyInArrow(pages_of, _PAGE_ROW), "mtree-pages")
    return space, Regions(centres, radius, subtrees), pages


def _page(row: dict, size: int) -> Page:
    numbers = {c: np.frombuffer(row[c], np.float64) for c in ("b1", "b2", "b3")}
    return Page(numbers["b1"], row["n1"], row["n2"], numbers["b2"].reshape(-1, size) if size else np.empty((len(numbers["b3"]), 0)), numbers["b3"], np.frombuffer(row["b4"], np.int64), np.frombuffer(row["b5"], np.int64))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE,
    region: int = REGION, subtree: int = SUBTREE, page: int = PAGE, rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest rows for every row that ``is_query`` picks."""
    spark = vectors.sparkSession
    ship(spark)
    # A query's own copies are an entry too, so k + 1 ids of an entry are enough.
    entries = materialise(_collapse(scaled(vectors, id_col, vec_col, scale), k + 1), "mtree-vectors")
    planted = plant(entries, region, subtree, page)
    if planted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space, regions, pages = planted
    sent = spark.sparkContext.broadcast((space, regions))
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(regions.subtrees.sum()) // 16))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = sent.value[0].pad(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "qv"])

    asked = scaled(vectors.filter(is_query), id_col, vec_col, scale).dropDuplicates().mapInArrow(pack, "query_id long, qv binary")
    queries = materialise(asked.select(F.monotonically_increasing_id().alias("ask"), "query_id", "qv"), "mtree-queries")

    def visits(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            space, regions = sent.value
            for b in batches:
                rows: list[tuple] = []
                for ask, query_id, qv, floor in zip(*(c.to_pylist() for c in b.columns)):
                    floor = -np.inf if floor is None else float(floor)
                    for r, away in zip(*(x.tolist() for x in regions.visits(space, np.frombuffer(qv, np.float64), floor, low, high))):
                        rows += [(r, s, ask, query_id, away, floor, qv, None, None, None, None) for s in range(regions.subtrees[r])]
                    if len(rows) > 5000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

        return run

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = sent.value[0]
        here, held = None, []
        for b in batches:
            out: list[list] = [[], [], [], []]
            for row in b.to_pylist():
                place = (row["region"], row["subtree"])
                if place != here:
                    here, held = place, []
                if row["ask"] < 0:  # the pages of a subtree come before its queries
                    held.append(_page(row, space.size))
                    continue
                scores, ids, _ = search_pages(space, held, np.frombuffer(row["b1"], np.float64), row["query_id"], row["n1"], k, row["n2"])
                for c, v in zip(out, (np.full(len(ids), row["ask"]), np.full(len(ids), row["query_id"]), ids, scores)):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["ask", "query_id", "vec_id", "score"])

    best, low = None, 0
    for more in (*rounds, len(regions.centres)):
        high = min(low + more, len(regions.centres))
        if low >= high:
            break
        if best is None:
            open_to = queries.withColumn("floor", F.lit(None).cast("long"))
        else:
            full = best.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter((F.col("n") == k) & (F.col("floor") > -_LONG - 1))
            open_to = queries.join(full.select("ask", "floor"), "ask", "left")
        sought = open_to.select("ask", "query_id", "qv", "floor").mapInArrow(visits(low, high), _PAGE_ROW)
        dealt = pages.unionByName(sought).repartition(tasks, "region", "subtree").sortWithinPartitions("region", "subtree", "ask")
        found = dealt.mapInArrow(meet, "ask long, query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("ask", "query_id", "vec_id", "score"))
        best = materialise(_best(found, k), "mtree-best")
        low = high
    return best.select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_sql() -> str:
    return f"""
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
    SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= {K}"""
