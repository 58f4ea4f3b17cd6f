"""Histogram trees of many fits at once: boosted ensembles and forests, in lock step.

Features are binned once to bytes. A row belongs to any number of fits (all rows, folds, groups, clusters); what a fit
learns from are (row, fit) pairs. One job per tree level adds up the (fit, node, feature, bin) sums of every fit together, so that
folds, groups and clusters cost the jobs of one fit. Fits of up to ``WHOLE_ROWS`` counted rows are dealt out by fit instead, and a task
grows a whole one by the same steps over the same sums: there a job per level would cost more than the level. Such a task keeps the node of every row
from level to level, and counts features of few bins together, as one number: their own sums are sums of those (``_Bundles``). The smaller child of a split is counted, its sibling is the
parent less it. Tasks add up their blocks, partial sums are merged in a tree, and the driver receives
sums alone: their size follows fits, nodes and bins, not rows.

Gradients are rounded to integers before they are added, so sums do not depend on their order and the trees
do not depend on the partitioning or on tasks that ran twice.

*Boosted trees* grow by leaf, not by level: a node's gain does not depend on the other nodes, so the tree grown to its
full depth holds every split that growing the best leaf first could choose, and is cut back to ``leaves`` in that order.
*Forests* draw Poisson counts of every row from a hash of row, fit and tree, balance the classes within each bag, and look at
a random part of the features in every node.

The blocks are a written table. Between the levels they are kept in memory as a cache that can be lost: its lineage is that table
and the trees already grown.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, functions as F

from riskweave.session import materialise

MAX_BINS = 255
BIN_ROWS = 100_000  # rows that bin edges are taken from at most
BLOCK_ROWS = 16_384  # so that a block's sums are exact in doubles
PAIRS_PER_TASK = 20_000  # below which more tasks cost more than they save
WHOLE_ROWS = 600_000  # rows of a fit that one task may grow (two bytes for each feature and one for each bundle, and 60 bytes)
BUNDLE = 256  # places of a bundle, so that a row's is a byte
TREES_PER_TASK = 75
TREES_AT_ONCE = 16  # of a forest in one task, 3 bytes a row for each
REBASE = 4  # rounds whose trees are applied anew in every job
GRADIENT_BITS = 32  # of a gradient of the largest class weight; fewer for more rows than 2 ** 30
HESSIAN = float(1 << 23)
LEAST_HESSIAN = 1e-3
FOREST_BINS = 32
SUMS = 3_000_000  # numbers in the sums of one forest job, about
_ONE = 1 << 15  # a row's place beside its rounded second derivative
_BAG = 1 << 20  # a row of class 0, beside those of class 1
_ROW, _COPIES = 15, 18  # bits of a block's rows, and of the copies of one class, in one number
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Chances of 0, 1, 2, ... copies of a row in a bag, added up, in units of 2^-32.
_POISSON = np.floor(np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720])) * 2.0**32).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, times in ((30, _M1), (27, _M2)):
        x ^= x >> np.uint64(shift)
        x *= times
    return x ^ (x >> np.uint64(31))


# --- binning and blocks ------------------------------------------------------------------------


@dataclass(frozen=True)
class Bins:
    """Upper edges of each feature's bins: bin b holds values above edge b - 1 and up to edge b."""

    edges: tuple[np.ndarray, ...]

    @property
    def counts(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])

    def of(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) bytes."""
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)]).astype(np.uint8)

    def coarse(self, most: int) -> Bins:
        """Fewer edges, evenly picked."""
        pick = lambda e: e if len(e) < most else e[np.unique(np.linspace(0, len(e) - 1, most - 1).round().astype(int))]
        return Bins(tuple(pick(e) for e in self.edges))


def edges_of(values: np.ndarray, most: int = MAX_BINS) -> np.ndarray:
    """Halfway between distinct values; between quantiles where there are more than ``most`` of them."""
    distinct, n = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(distinct) <= most:
        at = np.arange(len(distinct) - 1)
    else:
        wanted = np.arange(1, most) * n.sum() / most
        at = np.unique(np.searchsorted(np.cumsum(n), wanted))
        at = at[at < len(distinct) - 1]
    return (distinct[at] + distinct[at + 1]) / 2 if len(at) else np.empty(0)


def fit_bins(rows: DataFrame, key: str, features: str = "features", most: int = MAX_BINS, sample: int = BIN_ROWS) -> Bins:
    """Edges from all rows, or from about ``sample`` of them chosen by a hash of the key."""
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    column = rows.select(vector_to_array(features).alias("x")).toArrow().column("x").combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return Bins(tuple(edges_of(flat[:, f], most) for f in range(flat.shape[1])))


@dataclass
class Block:
    bins: np.ndarray  # (features, rows) bytes
    label: np.ndarray  # 0 or 1 of each row
    key: np.ndarray  # hash of each row's id
    row: np.ndarray  # of each pair
    fit: np.ndarray  # of each pair
    raw: np.ndarray | None = None  # of each pair, its score so far


def pack(rows: DataFrame, key: str, label: str, fits: Sequence[Column], bins: Bins, pairs: int, features: str = "features") -> RDD:
    """The rows as a table of binned blocks, read back as ``Block`` elements."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                sizes, member = np.asarray(part.column(3).value_lengths()), part.column(3).flatten().to_numpy()
                columns = [
                    bins.of(x).tobytes(), part.column(1).to_numpy().astype(np.uint8).tobytes(), part.column(2).to_numpy().tobytes(),
                    np.repeat(np.arange(part.num_rows, dtype=np.int32), sizes).tobytes(), member.astype(np.int16).tobytes(),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names)

    names = ["bins", "label", "key", "row", "fit"]
    member = F.array_compact(F.array(*[F.when(f, F.lit(i)) for i, f in enumerate(fits)]))
    slim = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), F.xxhash64(key).alias("k"), member.alias("m"))
    # Fewer tasks for few rows; rows of a large table stay where they are read.
    packed = materialise(slim.coalesce(max(1, pairs // PAIRS_PER_TASK)).mapInArrow(blocks, ", ".join(f"{n} binary" for n in names)), "blocks")

    def unpack(r: Row) -> Block:
        label = np.frombuffer(r.label, np.uint8)
        return Block(
            np.frombuffer(r.bins, np.uint8).reshape(-1, len(label)), label, np.frombuffer(r.key, np.uint64),
            np.frombuffer(r.row, np.int32).astype(np.int64), np.frombuffer(r.fit, np.int16).astype(np.int64),
        )

    return packed.rdd.map(unpack)


def fit_counts(rows: DataFrame, label: str, fits: Sequence[Column]) -> np.ndarray:
    """(fits, 2): rows of class 0 and 1 of every fit, in one scan."""
    sums = [F.count_if(f & (F.col(label) == c)) for f in fits for c in (0, 1)]
    return np.array(rows.agg(*[s.alias(str(i)) for i, s in enumerate(sums)]).first()).reshape(-1, 2)


# --- trees -------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Trees of equal depth, one for each row of the arrays; node 1 is the root, 2 i and 2 i + 1 are the children of i.

    ``feature`` is -1 where a node is not split. Values on the way of a split are not used.
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(n: int, depth: int) -> Trees:
        size = (n, 2 << depth)
        return Trees(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size), np.zeros(size), np.zeros(size))

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length() - 2

    def walk(self, bins: np.ndarray, tree: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The node at which each (tree, row) ends."""
        node = np.ones(len(row), dtype=np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                break
            at = node[live]
            # An ended pair stays at its node, which is never split.
            node[live] = 2 * at + (bins[f[live], row[live]] > self.bin[tree[live], at])
        return node

    def one(self, tree: int) -> Trees:
        return Trees(*(a[tree : tree + 1] for a in (self.feature, self.bin, self.value, self.cover, self.gain)))


def keep_best_leaves(feature: np.ndarray, gain: np.ndarray, leaves: int) -> np.ndarray:
    """Which splits of one full tree the best-first growth to ``leaves`` makes."""
    kept = np.zeros(len(feature), dtype=bool)
    heap = [(-gain[1], 1)] if feature[1] >= 0 else []
    while heap and kept.sum() + 1 < leaves:
        _, node = heapq.heappop(heap)
        kept[node] = True
        for child in (2 * node, 2 * node + 1):
            if child < len(feature) and feature[child] >= 0:
                heapq.heappush(heap, (-gain[child], child))
    return kept


def best_splits(sums: np.ndarray, feature_of: np.ndarray, may: np.ndarray, last: np.ndarray, score, least_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin place, gain, sums left of it) of the best split of each node; gain 0 where there is none.

    ``sums``: (nodes, kinds, places), kind 0 the rows; a feature's places are one run, and every run adds up to the
    node. ``score`` takes (..., kinds, ...) sums to the part of the objective they reach, nan where not allowed.
    """
    n = len(sums)
    place, gain, left = np.zeros(n, np.int64), np.zeros(n), np.zeros(sums.shape[:2], sums.dtype)
    for at in range(0, n, 64):
        part = sums[at : at + 64]
        total = part[:, :, feature_of == feature_of[0]].sum(axis=2, keepdims=True)
        under = np.cumsum(part, axis=2) - total * (feature_of - feature_of[0])
        over = total - under
        allowed = may[at : at + 64] & ~last & (under[:, 0] >= least_rows) & (over[:, 0] >= least_rows)
        with np.errstate(all="ignore"):
            found = score(under, at) + score(over, at) - score(total, at)
        found = np.where(allowed & (found > 0), found, 0.0)
        best = np.argmax(found, axis=1)
        rows = np.arange(len(part))
        place[at : at + 64], gain[at : at + 64], left[at : at + 64] = best, found[rows, best], under[rows, :, best]
    return place, gain, left


# --- boosting ----------------------------------------------------------------------------------


def _scores(block: Block, since: Sequence[Trees], pairs: np.ndarray) -> np.ndarray:
    raw = block.raw[pairs].copy()
    fit, row = block.fit[pairs], block.row[pairs]
    for trees in since:
        raw += trees.value[fit, trees.walk(block.bins, fit, row)]
    return raw


def _level_sums(blocks: Iterable[Block], since: Sequence[Trees], trees: Trees, slots: np.ndarray, n_slots: int, layout: _Layout, weights: np.ndarray) -> Iterator[np.ndarray]:
    """(slots, 3, places) sums of rows, gradients and second derivatives of the nodes that have a slot."""
    starts = layout.starts
    width = int(starts[-1])
    out = np.zeros((3, n_slots * width), dtype=np.int64)
    for block in blocks:
        slot = slots[block.fit, trees.walk(block.bins, block.fit, block.row)]
        pairs = np.flatnonzero(slot >= 0)
        if not len(pairs):
            continue
        slot, fit, row = slot[pairs], block.fit[pairs], block.row[pairs]
        y = block.label[row].astype(np.int64)
        p = 1 / (1 + np.exp(-_scores(block, since, pairs)))
        # In units of the fit's larger class weight: a block's sums stay exact in doubles.
        w = weights[fit, y] / weights[fit].max(axis=1)
        gradient = np.rint((p - y) * w * layout.gradient)
        curve = np.rint(p * (1 - p) * 4 * w * HESSIAN) * _ONE + 1
        at = (slot * width + (block.bins[:, row] + starts[:-1, None])).ravel()
        each = (len(starts) - 1, len(pairs))
        out[1] += np.bincount(at, np.broadcast_to(gradient, each).ravel(), len(out[1])).astype(np.int64)
        both = np.bincount(at, np.broadcast_to(curve, each).ravel(), len(out[1])).astype(np.int64)
        out[0] += both % _ONE
        out[2] += both // _ONE
    yield out.reshape(3, n_slots, width).transpose(1, 0, 2)


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 500
    step: float = 0.05
    leaves: int = 31
    depth: int = 6
    least_rows: int = 20
    columns: float = 0.8
    seed: int = 42


@dataclass
class Ensemble:
    """The trees of one fit, tree after tree, and what the score begins with."""

    trees: list[Trees] = field(default_factory=list)
    start: float = 0.0


@dataclass(frozen=True)
class _Layout:
    """Where the sums of a feature's bins lie, and how many units a gradient has."""

    counts: np.ndarray
    gradient: float

    @staticmethod
    def of(bins: Bins, rows: int) -> _Layout:
        return _Layout(bins.counts, float(1 << min(GRADIENT_BITS, 62 - int(rows).bit_length())))

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.counts))

    @property
    def feature_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def last(self) -> np.ndarray:
        out = np.zeros(int(self.counts.sum()), dtype=bool)
        out[self.starts[1:] - 1] = True
        return out


#: Sums of the nodes (fit, node) of partly grown trees.
Count = Callable[[Trees, np.ndarray, np.ndarray], np.ndarray]


def boost(
    blocks: RDD, bins: Bins, counts: np.ndarray, start: np.ndarray, widths: Sequence[int], settings: BoostSettings = BoostSettings(), whole_rows: int = WHOLE_ROWS
) -> list[Ensemble]:
    """Boosted trees of every fit on the logistic loss, the classes of a fit balanced.

    ``counts``: (fits, 2) rows by class; ``start``: the fits' first scores; ``widths``: the number of leading features a fit may use.
    """
    weights, layout = balanced(counts), _Layout.of(bins, int(counts.sum(axis=1).max()))
    small = counts.sum(axis=1) <= whole_rows
    out: dict[int, Ensemble] = {}
    if small.any():
        grow = partial(_boost_here, layout=layout, weights=weights, start=start, widths=list(widths), settings=settings)
        out |= dict(_by_fit(blocks, np.flatnonzero(small), 1).mapPartitionsWithIndex(partial(_each, grow)).collect())
    if not small.all():
        fits = np.flatnonzero(~small)
        base = blocks.map(partial(_only, fits)).map(partial(_started, start[fits]))
        found = _boost_in_step(base, layout, weights[fits], start[fits], [widths[f] for f in fits], settings)
        out |= dict(zip(fits.tolist(), found))
    return [out.get(f) or Ensemble(start=float(start[f])) for f in range(len(counts))]


def _boost_in_step(base: RDD, layout: _Layout, weights: np.ndarray, start: np.ndarray, widths: Sequence[int], settings: BoostSettings) -> list[Ensemble]:
    """One job per level for all fits."""
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    out, since = [Ensemble(start=float(s)) for s in start], []
    for number in range(settings.rounds):
        old = None
        if len(since) == REBASE:
            old, base = base, base.map(partial(_rebased, since)).persist(StorageLevel.MEMORY_AND_DISK)
            since = []

        def count(trees: Trees, fit: np.ndarray, node: np.ndarray, base: RDD = base, since: list = since) -> np.ndarray:
            level = partial(_level_sums, since=since, trees=trees, slots=_slots(trees, fit, node), n_slots=len(fit), layout=layout, weights=weights)
            return base.mapPartitions(level).treeReduce(np.add)

        trees = _grow(count, layout, _columns(widths, len(layout.counts), settings, number), weights, settings)
        if old is not None:
            old.unpersist()
        since = [*since, trees]
        for f, ensemble in enumerate(out):
            ensemble.trees.append(trees.one(f))
    base.unpersist()
    return out


@dataclass(frozen=True)
class _Bundles:
    """Features put together so that one number names the bins of several: the last feature of a bundle counts by one."""

    members: tuple[tuple[int, ...], ...]
    counts: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> _Bundles:
        """Each feature, the widest first, to the fullest bundle that has room for it."""
        members: list[list[int]] = []
        sizes: list[int] = []
        for f in np.argsort(-counts, kind="stable").tolist():
            room = [b for b, n in enumerate(sizes) if n * int(counts[f]) <= BUNDLE]
            if room:
                b = max(room, key=lambda b: sizes[b])
                members[b].append(f)
                sizes[b] *= int(counts[f])
            else:
                members.append([f])
                sizes.append(int(counts[f]))
        return _Bundles(tuple(map(tuple, members)), counts)

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """(bundles, rows) bytes of (features, rows) bytes."""
        out = np.zeros((len(self.members), bins.shape[1]), dtype=np.uint8)
        for code, features in zip(out, self.members):
            for f in features:
                code *= np.uint8(self.counts[f] % BUNDLE)  # a feature with BUNDLE bins is alone: its bundle is 0 here
                code += bins[f]
        return out

    def apart(self, sums: np.ndarray) -> np.ndarray:
        """(slots, kinds, places) of the features from (bundles, kinds, slots, BUNDLE)."""
        starts = np.append(0, np.cumsum(self.counts))
        out = np.empty((sums.shape[2], sums.shape[1], starts[-1]), dtype=sums.dtype)
        for part, features in zip(sums, self.members):
            shape = [int(self.counts[f]) for f in features]
            whole = part[:, :, : int(np.prod(shape))].reshape(*part.shape[:2], *shape)
            for k, f in enumerate(features):
                others = tuple(2 + i for i in range(len(features)) if i != k)
                out[:, :, starts[f] : starts[f + 1]] = whole.sum(axis=others).transpose(1, 0, 2)
        return out


def _advanced(node: np.ndarray, of_row: np.ndarray, width: int, feature: np.ndarray, split_at: np.ndarray) -> np.ndarray:
    """Each row's node one level down, where its node of this tree is split. ``of_row``: bins row after row."""
    f = feature[node]
    live = np.flatnonzero(f >= 0)
    if len(live):
        at = node[live]
        node[live] = 2 * at + (of_row[live * width + f[live]] > split_at[at])
    return node


class _Grown:
    """A block of one fit that a task grows whole: scores, and the nodes of the tree that is growing."""

    def __init__(self, block: Block, start: float, bundles: _Bundles, weights: np.ndarray):
        self.width, rows = len(block.bins), len(block.row)
        bins = block.bins[:, block.row]
        self.codes, self.of_row = bundles.codes(bins), np.ascontiguousarray(bins.T).ravel()
        self.label = block.label[block.row]
        self.weight = (weights / weights.max())[self.label]
        self.raw = np.full(rows, start)
        self.node = np.ones(rows, dtype=np.int32)

    def begin(self, layout: _Layout) -> None:
        """The sums' terms are those of ``_level_sums``."""
        p = 1 / (1 + np.exp(-self.raw))
        self.gradient = np.rint((p - self.label) * self.weight * layout.gradient)
        self.curve = np.rint(p * (1 - p) * 4 * self.weight * HESSIAN) * _ONE + 1
        self.node[:] = 1

    def add(self, trees: Trees, slots: np.ndarray, n_slots: int, out: np.ndarray) -> None:
        """Its sums by bundle, (bundles, 3, slots * BUNDLE), of the nodes that have a slot."""
        self.node = _advanced(self.node, self.of_row, self.width, trees.feature[0], trees.bin[0])
        slot = slots[0][self.node]
        rows = np.flatnonzero(slot >= 0)
        if not len(rows):
            return
        everything = len(rows) == len(slot)
        gradient, curve, base = (x if everything else x[rows] for x in (self.gradient, self.curve, slot * BUNDLE))
        for code, sums in zip(self.codes, out):
            at = base + (code if everything else code[rows])
            sums[1] += np.bincount(at, gradient, n_slots * BUNDLE).astype(np.int64)
            both = np.bincount(at, curve, n_slots * BUNDLE).astype(np.int64)
            sums[0] += both & (_ONE - 1)
            sums[2] += both >> (_ONE.bit_length() - 1)

    def end(self, trees: Trees) -> None:
        """The finished tree is cut back: a row is at the last node on its way that is left."""
        node = _advanced(self.node, self.of_row, self.width, trees.feature[0], trees.bin[0])
        leaf = np.arange(trees.feature.shape[1])
        for n in range(2, len(leaf)):
            if trees.feature[0, leaf[n >> 1]] < 0 or leaf[n >> 1] != n >> 1:
                leaf[n] = leaf[n >> 1]
        self.raw += trees.value[0][leaf[node]]


def _boost_here(number: int, blocks: list[Block], layout: _Layout, weights: np.ndarray, start: np.ndarray, widths: list[int], settings: BoostSettings) -> tuple[int, Ensemble]:
    """All rounds of one fit over blocks held in this task. Its number is that of its pairs."""
    number = int(blocks[0].fit[0])
    here, out = weights[number : number + 1], Ensemble(start=float(start[number]))
    bundles = _Bundles.of(layout.counts)
    grown = [_Grown(b, float(start[number]), bundles, here[0]) for b in blocks]
    blocks.clear()

    def count(trees: Trees, fit: np.ndarray, node: np.ndarray) -> np.ndarray:
        slots, sums = _slots(trees, fit, node), np.zeros((len(bundles.members), 3, len(fit) * BUNDLE), dtype=np.int64)
        for g in grown:
            g.add(trees, slots, len(fit), sums)
        return bundles.apart(sums.reshape(len(sums), 3, len(fit), BUNDLE))

    for i in range(settings.rounds):
        for g in grown:
            g.begin(layout)
        trees = _grow(count, layout, _columns([widths[number]], len(layout.counts), settings, i), here, settings)
        out.trees.append(trees)
        for g in grown:
            g.end(trees)
    return number, out


def _rebased(since: Sequence[Trees], block: Block) -> Block:
    return replace(block, raw=_scores(block, since, np.arange(len(block.row))))


def _started(start: np.ndarray, block: Block) -> Block:
    return replace(block, raw=start[block.fit].astype(float))


def _only(fits: np.ndarray, block: Block) -> Block:
    """The pairs of some fits, numbered anew."""
    number = np.full(max(int(fits.max()), int(block.fit.max(initial=0))) + 1, -1)
    number[fits] = np.arange(len(fits))
    kept = number[block.fit] >= 0
    return replace(block, row=block.row[kept], fit=number[block.fit[kept]])


def _by_fit(blocks: RDD, fits: np.ndarray, copies: int) -> RDD:
    """The rows of each named fit in ``copies`` partitions, the partitions in the order of ``fits``. Fits are small by their counted rows."""
    place = {int(f): i for i, f in enumerate(fits)}

    def deal(block: Block) -> Iterator[tuple[int, Block]]:
        for f, i in place.items():
            rows = block.row[block.fit == f]
            if len(rows):
                part = Block(np.ascontiguousarray(block.bins[:, rows]), block.label[rows], block.key[rows], np.arange(len(rows)), np.full(len(rows), f))
                for c in range(copies):
                    yield i * copies + c, part

    return blocks.flatMap(deal).partitionBy(len(place) * copies, int)


def _each(grow: Callable, number: int, dealt: Iterator[tuple[int, Block]]) -> Iterator:
    """``grow`` over the partition's rows, in blocks as full as they may be."""
    parts = [b for _, b in dealt]
    if parts:
        bins = np.concatenate([b.bins for b in parts], axis=1)
        label, key, fit = (np.concatenate([getattr(b, c) for b in parts]) for c in ("label", "key", "fit"))
        parts.clear()
        cuts = [slice(at, min(at + BLOCK_ROWS, len(label))) for at in range(0, len(label), BLOCK_ROWS)]
        yield grow(number, [Block(bins[:, c], label[c], key[c], np.arange(c.stop - c.start), fit[c]) for c in cuts])


def _slots(trees: Trees, owner: np.ndarray, node: np.ndarray) -> np.ndarray:
    slots = np.full(trees.feature.shape, -1, dtype=np.int64)
    slots[owner, node] = np.arange(len(owner))
    return slots


def _columns(widths: Sequence[int], width: int, settings: BoostSettings, number: int) -> np.ndarray:
    """(fits, features): the part of its features that each fit may use in this round."""
    chosen = np.zeros((len(widths), width), dtype=bool)
    for f, mine in enumerate(widths):
        some = np.random.default_rng((settings.seed, number)).permutation(mine)
        chosen[f, some[: max(1, round(settings.columns * mine))]] = True
    return chosen


def _grow(count: Count, layout: _Layout, chosen: np.ndarray, weights: np.ndarray, settings: BoostSettings) -> Trees:
    """One tree of every fit: full levels first, then cut back to the best leaves."""
    fits, top = len(weights), weights.max(axis=1)
    starts, feature_of, last = layout.starts, layout.feature_of, layout.last
    first = feature_of == 0
    trees = Trees.empty(fits, settings.depth)
    unit = np.stack([np.ones(fits), top / layout.gradient, top / (4 * HESSIAN)], axis=1)[:, :, None]  # what one of each sum stands for
    fit, node = np.arange(fits), np.ones(fits, dtype=np.int64)
    totals = np.zeros((*trees.feature.shape, 3))
    sums = count(trees, fit, node)
    for level in range(settings.depth):
        scaled = unit[fit]

        def score(part: np.ndarray, at: int, scaled: np.ndarray = scaled) -> np.ndarray:
            values = part * scaled[at : at + len(part)]
            return np.where(values[:, 2] >= LEAST_HESSIAN, values[:, 1] ** 2 / values[:, 2], np.nan)

        totals[fit, node] = sums[:, :, first].sum(axis=2) * scaled[:, :, 0]
        place, gain, left = best_splits(sums, feature_of, chosen[fit][:, feature_of], last, score, settings.least_rows)
        split = np.flatnonzero(gain > 0)
        if not len(split):
            break
        at, owner = node[split], fit[split]
        trees.feature[owner, at], trees.bin[owner, at] = feature_of[place[split]], place[split] - starts[feature_of[place[split]]]
        trees.gain[owner, at] = gain[split]
        left_totals = left[split] * scaled[split, :, 0]
        totals[owner, 2 * at], totals[owner, 2 * at + 1] = left_totals, totals[owner, at] - left_totals
        if level + 1 == settings.depth:
            break
        # The smaller child is counted; the other is what remains of the parent.
        small = 2 * at + (2 * left[split, 0] > sums[split, 0][:, first].sum(axis=1))
        counted = count(trees, owner, small)
        fit, node = np.repeat(owner, 2), np.stack([small, small ^ 1], axis=1).ravel()
        sums = np.stack([counted, sums[split] - counted], axis=1).reshape(-1, *counted.shape[1:])
    trees.cover = totals[:, :, 0].copy()
    with np.errstate(all="ignore"):
        trees.value = np.where(totals[:, :, 2] > 0, -settings.step * totals[:, :, 1] / totals[:, :, 2], 0.0)
    for f in range(fits):
        cut = ~keep_best_leaves(trees.feature[f], trees.gain[f], settings.leaves)
        trees.feature[f, cut] = -1
        trees.gain[f, cut] = 0.0
    return trees


# --- forests -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 300
    depth: int = 8
    least_rows: int = 20
    seed: int = 42


def bag_counts(key: np.ndarray, fit: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of its fit's tree."""
    which = mixed(np.uint64(seed) + (fit.astype(np.uint64) << np.uint64(32)) + np.uint64(tree))
    drawn = mixed(key ^ which) >> np.uint64(32)
    return np.searchsorted(_POISSON, drawn, "right")


def node_features(seed: int, owner: np.ndarray, node: np.ndarray, width: int, some: int) -> np.ndarray:
    """(nodes, some) features that a node may split by, in random order."""
    at = mixed(np.uint64(seed) + (owner.astype(np.uint64) << np.uint64(20)) + node.astype(np.uint64))
    keys = mixed(at[:, None] + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.argsort(keys, axis=1, kind="stable")[:, :some]


@dataclass(frozen=True)
class _Bags:
    """A batch of trees: ``many`` from ``first`` on, of the fits named by ``fits``."""

    fits: np.ndarray
    first: int
    many: int
    seed: int
    bins: int
    to_coarse: np.ndarray


def _bag_sums(blocks: Iterable[Block], bags: _Bags, trees: Trees, slots: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """(slots, 3, places) sums of rows, class 1 and class 0 of the bags; a slot's places are those of its candidate features."""
    n_slots, some = candidates.shape
    size = n_slots * some * bags.bins
    out = np.zeros((3, size), dtype=np.int64)
    for block in blocks:
        y, key, named = block.label[block.row], block.key[block.row], bags.fits[block.fit]
        for t in range(bags.many):
            copies = bag_counts(key, named, bags.first + t, bags.seed)
            held = np.flatnonzero(copies)
            owner = block.fit[held] * bags.many + t
            slot = slots[owner, trees.walk(block.bins, owner, block.row[held])]
            held, slot = held[slot >= 0], slot[slot >= 0]
            amount = np.where(y[held] == 1, copies[held], copies[held] * _BAG)
            f = candidates[slot]
            place = bags.to_coarse[f, block.bins[f, block.row[held][:, None]]]
            at = ((slot[:, None] * some + np.arange(some)) * bags.bins + place).ravel()
            both = np.bincount(at, np.repeat(amount, some), size).astype(np.int64)
            out[0] += np.bincount(at, minlength=size)
            out[1] += both % _BAG
            out[2] += both // _BAG
    yield out.reshape(3, n_slots, some * bags.bins).transpose(1, 0, 2)


def grow_forests(blocks: RDD, bins: Bins, counts: np.ndarray, settings: ForestSettings = ForestSettings(), whole_rows: int = WHOLE_ROWS) -> list[Ensemble]:
    """Forests of every fit; a leaf's value is its share of class 1 with the classes of its bag balanced.

    ``counts``: (fits, 2) rows by class. All trees of a batch, of all large fits, are one job per level.
    """
    coarse = bins.coarse(FOREST_BINS)
    to_coarse = np.zeros((len(bins.edges), MAX_BINS + 1), dtype=np.int64)
    upper = []
    for f, (fine, few) in enumerate(zip(bins.edges, coarse.edges)):
        to_coarse[f, : len(fine) + 1] = np.searchsorted(few, np.append(fine, np.inf), "left")
        # The last fine bin of each coarse one: splits are kept in fine bins.
        upper.append(np.append(np.searchsorted(fine, few, "left"), 0))
    most, width = int(coarse.counts.max()), len(bins.edges)
    rows = counts.sum(axis=1)
    small = rows <= whole_rows
    out: dict[int, list[tuple[int, list[Trees]]]] = {f: [] for f in range(len(counts))}
    grow = partial(_grow_bags, upper=upper, width=width, settings=settings)
    if small.any():
        # Trees do not depend on each other: several tasks share those of one fit.
        fits, copies = np.flatnonzero(small), max(1, settings.trees // TREES_PER_TASK)
        cuts = np.linspace(0, settings.trees, copies + 1).astype(int)
        here = partial(_grow_here, grow=grow, cuts=cuts, most=most, to_coarse=to_coarse, settings=settings)
        for f, first, trees in _by_fit(blocks, fits, copies).mapPartitionsWithIndex(partial(_each, here)).collect():
            out[f].append((first, trees))
    if not small.all():
        fits = np.flatnonzero(~small)
        held = blocks.map(partial(_only, fits)).persist(StorageLevel.MEMORY_AND_DISK)
        many = _batch(len(fits), int(rows.max()), width, most, settings)
        for first in range(0, settings.trees, many):
            batch = _Bags(fits, first, min(many, settings.trees - first), settings.seed, most, to_coarse)
            trees = grow(lambda t, s, c, batch=batch: held.mapPartitions(partial(_bag_sums, bags=batch, trees=t, slots=s, candidates=c)).treeReduce(np.add), batch)
            for i, f in enumerate(fits.tolist()):
                out[f].append((first, [trees.one(i * batch.many + t) for t in range(batch.many)]))
        held.unpersist()
    return [Ensemble([t for _, trees in sorted(out[f], key=lambda x: x[0]) for t in trees]) for f in range(len(counts))]


def _batch(fits: int, rows: int, width: int, most: int, settings: ForestSettings) -> int:
    """Trees of each fit whose sums are about ``SUMS`` numbers at the widest level."""
    crowded = max(1, min(1 << (settings.depth - 1), rows // (4 * max(1, settings.least_rows))))
    return max(1, min(settings.trees, SUMS // (3 * fits * max(1, int(width**0.5)) * most * crowded)))


class _Bagged:
    """A block of one fit: the bags of a batch of its trees, and the nodes of their rows; 0 is out of the bag."""

    def __init__(self, block: Block, to_coarse: np.ndarray):
        self.width, bins = len(block.bins), block.bins[:, block.row]
        self.of_row = np.ascontiguousarray(bins.T).ravel()
        self.coarse = np.ascontiguousarray(to_coarse[np.arange(self.width)[:, None], bins].T.astype(np.uint8)).ravel()
        self.label, self.key = block.label[block.row], block.key[block.row]

    def begin(self, bags: _Bags) -> None:
        named = np.full(len(self.key), bags.fits[0])
        self.copies = [bag_counts(self.key, named, bags.first + t, bags.seed).astype(np.uint8) for t in range(bags.many)]
        self.node = [np.minimum(c, 1).astype(np.int16) for c in self.copies]

    def add(self, bags: _Bags, trees: Trees, slots: np.ndarray, candidates: np.ndarray, out: np.ndarray) -> None:
        """Its sums as ``_bag_sums`` has them, flat: (3, places)."""
        some = candidates.shape[1]
        for t in range(bags.many):
            self.node[t] = _advanced(self.node[t], self.of_row, self.width, trees.feature[t], trees.bin[t])
            slot = slots[t][self.node[t]]
            rows = np.flatnonzero(slot >= 0)
            if not len(rows):
                continue
            slot, copies = slot[rows], self.copies[t][rows].astype(np.int64)
            # Rows, copies of class 1 and copies of class 0 in one number: a block's sums stay exact in doubles.
            amount = ((copies << np.where(self.label[rows] == 1, _ROW, _ROW + _COPIES)) + 1).astype(float)
            low, high = int(slot.min()), int(slot.max()) + 1
            chosen, places, n = candidates[low:high], rows * self.width, high - low
            slot = slot - low
            for j in range(some):
                at = slot * bags.bins + self.coarse[places + chosen[:, j][slot]]
                whole = np.bincount(at, amount, n * bags.bins).astype(np.int64).reshape(n, bags.bins)
                out[0, low:high, j] += whole & ((1 << _ROW) - 1)
                out[1, low:high, j] += (whole >> _ROW) & ((1 << _COPIES) - 1)
                out[2, low:high, j] += whole >> (_ROW + _COPIES)


def _grow_here(number: int, blocks: list[Block], grow: Callable, cuts: np.ndarray, most: int, to_coarse: np.ndarray, settings: ForestSettings) -> tuple[int, int, list[Trees]]:
    """Some trees of one fit over blocks held in this task."""
    fit, part = int(blocks[0].fit[0]), number % (len(cuts) - 1)
    first, last = int(cuts[part]), int(cuts[part + 1])
    many = min(TREES_AT_ONCE, _batch(1, sum(len(b.row) for b in blocks), to_coarse.shape[0], most, settings))
    held, trees = [_Bagged(b, to_coarse) for b in blocks], []
    blocks.clear()
    for at in range(first, last, many):
        batch = _Bags(np.array([fit]), at, min(many, last - at), settings.seed, most, to_coarse)
        for b in held:
            b.begin(batch)

        def count(grown: Trees, slots: np.ndarray, candidates: np.ndarray, batch: _Bags = batch) -> np.ndarray:
            out = np.zeros((3, *candidates.shape, most), dtype=np.int64)
            for b in held:
                b.add(batch, grown, slots, candidates, out)
            return out.reshape(3, len(candidates), -1).transpose(1, 0, 2)

        grown = grow(count, batch)
        trees += [grown.one(t) for t in range(batch.many)]
    return fit, first, trees


def _grow_bags(count: Callable[[Trees, np.ndarray, np.ndarray], np.ndarray], bags: _Bags, upper: list, width: int, settings: ForestSettings) -> Trees:
    """All trees of a batch. ``count`` gives the sums of the nodes that have a slot, by their candidate features."""
    n, some, most = len(bags.fits) * bags.many, max(1, int(width**0.5)), bags.bins
    trees = Trees.empty(n, settings.depth)
    owner, node = np.arange(n), np.ones(n, dtype=np.int64)
    # A tree is known by its fit and its number among all of the fit's, whatever the batch.
    name = bags.fits[owner // bags.many] * 1_000_003 + bags.first + owner % bags.many
    run_of = np.repeat(np.arange(some), most)
    last = np.arange(some * most) % most == most - 1
    balance = np.ones((n, 3))
    totals = np.zeros((*trees.feature.shape, 3))
    step = max(1, SUMS // (3 * some * most))
    for level in range(settings.depth):
        candidates = node_features(settings.seed, name[owner], node, width, some)
        # In as many parts as the size of the sums asks for.
        parts = [count(trees, _slots(trees, owner[at : at + step], node[at : at + step]), candidates[at : at + step]) for at in range(0, len(owner), step)]
        sums = np.concatenate(parts)
        whole = sums[:, :, :most].sum(axis=2)
        if level == 0:
            classes = whole[:, 1:].astype(float)
            balance[:, 1:] = classes.sum(axis=1, keepdims=True) / (2 * np.maximum(classes, 1))
        scaled = balance[owner][:, :, None]

        def score(part: np.ndarray, at: int, scaled: np.ndarray = scaled) -> np.ndarray:
            values = part * scaled[at : at + len(part)]
            return (values[:, 1] ** 2 + values[:, 2] ** 2) / (values[:, 1] + values[:, 2])

        totals[owner, node] = whole * scaled[:, :, 0]
        place, gain, left = best_splits(sums, run_of, np.ones(sums[:, 0].shape, dtype=bool), last, score, settings.least_rows)
        split = np.flatnonzero(gain > 1e-9 * totals[owner, node, 1:].sum(axis=1))
        if not len(split):
            break
        at, of = node[split], owner[split]
        chosen = candidates[split, place[split] // most]
        trees.feature[of, at] = chosen
        trees.bin[of, at] = [upper[f][b] for f, b in zip(chosen, place[split] % most)]
        trees.gain[of, at] = gain[split] / totals[of, 1, 1:].sum(axis=1)
        left_totals = left[split] * scaled[split, :, 0]
        totals[of, 2 * at], totals[of, 2 * at + 1] = left_totals, totals[of, at] - left_totals
        owner, node = np.repeat(of, 2), np.stack([2 * at, 2 * at + 1], axis=1).ravel()
    trees.cover = totals[:, :, 1:].sum(axis=2)
    with np.errstate(all="ignore"):
        trees.value = np.where(trees.cover > 0, totals[:, :, 1] / trees.cover, 0.0)
    return trees


# --- the fitted ensembles ----------------------------------------------------------------------


def balanced(counts: np.ndarray) -> np.ndarray:
    """(fits, 2) weights n / (2 n_class)."""
    return counts.sum(axis=1, keepdims=True) / (2 * np.maximum(counts, 1))


def nodes_of(ensemble: Ensemble, bins: Bins, share: float = 1.0) -> Mapping[str, np.ndarray]:
    """One row per node: tree, id, feature, threshold, left, right, value, cover, gain. ``share`` multiplies the values."""
    columns: dict[str, list] = {c: [] for c in ("tree", "id", "feature", "threshold", "left", "right", "value", "cover", "gain")}
    for number, tree in enumerate(ensemble.trees):
        place, order = {1: 0}, [1]
        for node in order:
            if tree.feature[0, node] >= 0:
                for child in (2 * node, 2 * node + 1):
                    place[child] = len(order)
                    order.append(child)
        for node in order:
            f = int(tree.feature[0, node])
            columns["tree"].append(number)
            columns["id"].append(place[node])
            columns["feature"].append(f)
            columns["threshold"].append(float(bins.edges[f][tree.bin[0, node]]) if f >= 0 else 0.0)
            columns["left"].append(place[2 * node] if f >= 0 else -1)
            columns["right"].append(place[2 * node + 1] if f >= 0 else -1)
            columns["value"].append(float(tree.value[0, node]) * share)
            columns["cover"].append(float(tree.cover[0, node]))
            columns["gain"].append(float(tree.gain[0, node]))
    return {c: np.array(v) for c, v in columns.items()}
