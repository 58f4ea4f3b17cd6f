"""Jaccard join of n-gram sets in the metric space of Jaccard distances.

Documents link when the intersection of their shingle sets is at least ``PERCENT`` per cent of the
union, that is when their distance is at most ``EPS``. The way there:

1. Equal sets become one set. Documents of one set share its class.
2. A set's *prefix* is the first of its shingles in one order of all shingles, so many that
   linked sets share one of them (an exact rule). First in the order are the shingles of one
   set alone: they are looked for among a fixed part of all hashes (``LOOKED_AT``), whose
   postings are the one large shuffle. A set whose whole prefix is its own links with nothing
   and is done, as most are. The others' prefixes go on with other shingles and end with the
   most frequent ones. Sets that share prefix shingles, directly or through others, are a *block*;
   links never leave a block.
3. A block is joined in the metric space. Pivots split it into Voronoi regions; a set goes to the
   region of its nearest pivot and to each region whose pivot is nearer than that distance
   plus ``2 EPS``, which the triangle inequality proves to be enough for every link to lie in
   some region. Regions are split again with pivots of their own. In a region that pivots
   no longer split, a set is compared with those that share a prefix shingle and whose
   distances to the region's pivots differ from its own by at most ``EPS``.
   Classes are grown by search from set to set, so a set that has joined is not compared with others of its class again.
4. Blocks with more shingles than one task should hold are cut first. Every set has a sketch, the parities of
   its shingles' hashes, about a bit for each shingle: two sketches differ in at most as many bits as the sets in shingles, so sketches
   that differ in more belong to no link. Sketches, not sets, meet by shared prefix shingle, and what they tie together is a
   block anew. Blocks that are too large even so (of real near copies) are spread by rings of width ``EPS`` around pivots, each set also
   in the next ring, and what is still too large by pairs of chunks. Their links meet in
   connected components over tables.

Pivots alone cannot start the work: most texts have distance 1 to any other text, where no pivot tells
them apart; the prefix rule stands in for a first level of pivots (single shingles).

Shingles are compared by 64-bit hashes, and so are sets.

Cases: null, empty and blank texts have the empty set, link with nothing and are their own
class. Texts with fewer words than a shingle are one shingle. Repeated rows and equal texts are one
class. Null ids take part and are never a class id (a class of null ids alone has a null one). Texts of any length
are whole. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskweave.llm.common import ngram_hashes, ship, space_words, table, word_hashes
from riskweave.llm.components import components
from riskweave.session import materialise

WORDS = 3
PERCENT = 90
CAPACITY = 4_000_000  # shingles that one task's block or cell holds at most
FILTER_BITS = 1 << 26  # 8 MiB
AT_ONCE = 1 << 18  # shingles of a block that are looked up at once
LEAF = 512  # sets that are joined without further pivots
PIVOTS = 16
RINGS = 3  # levels of rings for cells over capacity
LOOKED_AT = 0.22  # part of all hashes that is looked through for shingles of one set alone, for prefixes of a tenth
SAMPLE = 8_000  # documents read to learn which shingles are frequent; places only, no results
FREQUENT = 100_000  # frequent shingles remembered at most


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = space_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(n, len(words))))


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(both: np.ndarray, left: np.ndarray | int, right: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sets of these sizes and intersection are similar enough, in whole numbers."""
    return 100 * both >= percent * (left + right - both)


class Region:
    """Sets of one block: their shingles as small numbers, one after the other."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.eps = percent, 1 - percent / 100
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        distinct, often = np.unique(np.concatenate(sets), return_counts=True)
        # Numbers in order of frequency: a set's first numbers are its rarest shingles.
        rank = np.empty(len(often), dtype=np.int32)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
        self.items = np.empty(self.starts[-1], dtype=np.int32)
        self.width = len(often)
        self.marks = np.zeros(self.width, dtype=bool)
        for first, last in self.spans(self.sizes):
            a, b = self.starts[first], self.starts[last]
            self.items[a:b] = rank[np.searchsorted(distinct, np.concatenate(sets[first:last]))]
        for i in range(len(sets)):
            self.items[self.starts[i] : self.starts[i + 1]].sort()
        self.root = np.arange(len(sets))

    @staticmethod
    def spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of sets of about ``AT_ONCE`` shingles, one set at least."""
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + AT_ONCE, "right")))
            yield first, last
            first = last

    def of(self, i: int) -> np.ndarray:
        return self.items[self.starts[i] : self.starts[i + 1]]

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set ``i`` with others."""
        if not len(others):
            return np.empty(0, dtype=np.int64)
        own = self.of(i)
        self.marks[own] = True
        found = np.empty(len(others), dtype=np.int64)
        for first, last in self.spans(self.sizes[others]):
            part = others[first:last]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - sizes), sizes)
            found[first:last] = np.add.reduceat(self.marks[self.items[places]], ends - sizes, dtype=np.int64)
        self.marks[own] = False
        return found

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        both = self.shared(i, others)
        return 1 - both / (self.sizes[i] + self.sizes[others] - both)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def unite(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def join(self, members: np.ndarray) -> None:
        """Unite all linked members, region by region."""
        if len(members) <= 2:
            if len(members) == 2 and self.links(members[0], members[1:])[0]:
                self.unite(*members)
            return
        if len(members) <= LEAF:
            self.leaf(members, members[: min(4, len(members))])
            return
        step = len(members) / PIVOTS
        pivots = members[(np.arange(PIVOTS) * step).astype(np.int64)]
        d = np.stack([self.distances(p, members) for p in pivots])
        nearest = d.min(axis=0)
        # A set's own region and those within the window; nearest distance 1 is near no pivot.
        within = d <= nearest + 2 * self.eps + 1e-9
        regions = [members[w] for w in within]
        if max(map(len, regions)) > 0.8 * len(members):
            self.leaf(members, pivots[:4])
            return
        for region in regions:
            self.join(region)

    def links(self, i: int, others: np.ndarray) -> np.ndarray:
        return linked(self.shared(i, others), self.sizes[i], self.sizes[others], self.percent)

    def leaf(self, members: np.ndarray, pivots: np.ndarray) -> None:
        """Grow classes by search; prefix, size and triangle windows choose the comparisons."""
        d = np.stack([self.distances(p, members) for p in pivots])
        sizes = self.sizes[members]
        prefixes = [self.of(i)[: prefix_size(len(self.of(i)), self.percent)] for i in members]
        lengths = np.array([len(p) for p in prefixes])
        posted, owner = np.concatenate(prefixes), np.repeat(np.arange(len(members)), lengths)
        order = np.argsort(posted, kind="stable")
        posted, owner = posted[order], owner[order]
        waiting = np.ones(len(members), dtype=bool)
        for first in range(len(members)):
            if not waiting[first]:
                continue
            waiting[first] = False
            queue = [first]
            while queue:
                x = queue.pop()
                low, high = np.searchsorted(posted, prefixes[x]), np.searchsorted(posted, prefixes[x], "right")
                several = high - low > 1
                if not several.any():
                    continue
                near = np.unique(np.concatenate([owner[a:b] for a, b in zip(low[several], high[several])]))
                near = near[waiting[near]]
                near = near[(100 * sizes[near] >= self.percent * sizes[x]) & (100 * sizes[x] >= self.percent * sizes[near])]
                near = near[(np.abs(d[:, near] - d[:, x : x + 1]) <= self.eps + 1e-9).all(axis=0)]
                found = near[self.links(members[x], members[near])]
                waiting[found] = False
                queue.extend(found.tolist())
                for y in found:
                    self.unite(members[x], members[y])


def classes(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the place of the first set of its class."""
    if len(sets) < 2:
        return np.arange(len(sets))
    region = Region(sets, percent)
    region.join(np.arange(len(sets)))
    return np.array([region.find(i) for i in range(len(sets))])


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of a set's hashes, as many bits as it has shingles or up to twice as many."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def near_classes(sizes: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """For each set the place of the first set that sketches tie it to, directly or through others.

    Linked sets differ in at most (100 - percent) / (100 + percent) of their shingles, and their sketches in no more bits: all links are
    among these ties.
    """
    root, words = np.arange(len(sizes)), np.array([len(s) // 8 for s in sketches])
    # Sketches of each width: its own, and wider ones folded to it.
    held = {}
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words >= w)
        place = np.full(len(sizes), -1)
        place[rows] = np.arange(len(rows))
        held[w] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, w), axis=0) for i in rows])
    waiting = np.ones(len(sizes), dtype=bool)
    for first in range(len(sizes)):
        if not waiting[first]:
            continue
        waiting[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(waiting & (100 * sizes >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes))
            narrower = np.minimum(words[near], words[x])
            for w in np.unique(narrower).tolist():
                (place, bits), some = held[w], near[narrower == w]
                apart = np.bitwise_count(bits[place[some]] ^ bits[place[x]]).sum(axis=1, dtype=np.int64)
                found = some[(100 + percent) * apart <= (100 - percent) * (sizes[some] + sizes[x])]
                waiting[found] = False
                root[found] = first
                queue.extend(found.tolist())
    return root


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash that names a row by its id and text, nulls included."""
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit("")))


def _frequent(docs: DataFrame, n: int, sample: int) -> np.ndarray:
    """Hashes of frequent shingles, most frequent last. From a sample, of bounded number."""
    total = docs.count()
    part = docs if total <= sample else docs.sample(sample / total, seed=5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingles(t.as_py(), n) for t in b.column(0)]
            grams, c = np.unique(np.concatenate(held), return_counts=True) if held else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(grams, dtype=np.uint64).view(np.int64)), pa.array(np.asarray(c, dtype=np.int64))], ["g", "c"])

    counted = part.select("text").mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).filter("c >= 4")
    top = counted.orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
    grams, c = top.column("g").to_numpy().view(np.uint64), top.column("c").to_numpy()
    return grams[np.lexsort((grams, c))]


def _order_parts(s: np.ndarray, known: np.ndarray, below: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Masks of a set's shingles: frequent ones, and others in the part that is looked at."""
    frequent = np.zeros(len(s), dtype=bool)
    if len(known):
        frequent = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
    return frequent, (s < below) & ~frequent


def _sign(docs: DataFrame, n: int, sent) -> DataFrame:
    """(doc_id, key, n_shingles, sid, looked_at) of every document; sid null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _, below = sent.value
        for b in batches:
            sizes, ids, looked = [], [], []
            for text in b.column(2):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                looked.append(int(_order_parts(s, known, below)[1].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(looked, pa.int64())],
                ["doc_id", "key", "n_shingles", "sid", "looked_at"],
            )

    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    return materialise(keyed.mapInArrow(run, "doc_id long, key long, n_shingles long, sid long, looked_at long"), "signatures")


def _shared_shingles(docs: DataFrame, n: int, sent) -> DataFrame:
    """(sid, shared): for each set, its looked-at shingles that another set has too, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, _, below), seen = sent.value, set()
        for b in batches:
            held: list[tuple[int, np.ndarray]] = []
            for text in b.column(0):
                s = shingles(text.as_py(), n)
                sid = set_id(s) if len(s) else None
                if sid is not None and sid not in seen:  # copies within a task post once
                    seen.add(sid)
                    held.append((sid, s[_order_parts(s, known, below)[1]]))
            if held:
                g = np.concatenate([x for _, x in held]).view(np.int64)
                of = np.repeat(np.array([i for i, _ in held], dtype=np.int64), [len(x) for _, x in held])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(of)], ["g", "sid"])

    # The frequent shingles are not posted, so no shingle has many rows here.
    posted = docs.select("text").mapInArrow(run, "g long, sid long")
    of_one = Window.partitionBy("g")
    both = posted.withColumns({"low": F.min("sid").over(of_one), "high": F.max("sid").over(of_one), "n": F.count(F.lit(1)).over(of_one)})
    ranked = both.filter("low <> high").groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("n", "g"))).alias("ranked"))
    return ranked.select("sid", F.transform("ranked", lambda r: r["g"]).alias("shared"))


def _filter_of(members: DataFrame) -> np.ndarray:
    """One bit for each member's hash, of ``FILTER_BITS``: a set whose bit is not there is no member.

    Its size is fixed. With very many members more sets pass that are none; the join by ``sid`` sorts them out.
    """
    slice_bits = 1 << 16

    def build(part: pa.Table) -> pa.Table:
        at = part.column("sid").to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)
        bits = np.zeros(slice_bits, dtype=bool)
        bits[(at % np.uint64(slice_bits)).astype(np.int64)] = True
        return pa.table({"slice": pa.array([int(at[0]) // slice_bits], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((at // np.uint64(slice_bits)).astype(np.int32))], ["sid", "slice"])

    parts = members.select("sid").mapInArrow(place, "sid long, slice int").groupBy("slice").applyInArrow(build, "slice int, bits binary").toArrow()
    out = np.zeros((FILTER_BITS // slice_bits, slice_bits // 8), dtype=np.uint8)
    for at, bits in zip(parts.column("slice").to_pylist(), parts.column("bits").to_pylist()):
        out[at] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1)


def _whole_sets(docs: DataFrame, members: DataFrame, n: int, percent: int, sent) -> DataFrame:
    """(sid, g, prefix): whole sets of the members (sid, shared), made again from the texts, which stay where they are.

    ``prefix`` leaves out the shingles that no other set has.
    """
    passing = docs.sparkSession.sparkContext.broadcast(_filter_of(members))  # FILTER_BITS, fixed

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = passing.value, set()
        for b in batches:
            ids, sets = [], []
            for text in b.column(0):
                s = shingles(text.as_py(), n)
                sid = set_id(s) if len(s) else None
                if sid is None or sid in seen:
                    continue
                at = sid % (1 << 64) % FILTER_BITS
                if bits[at >> 3] >> (at & 7) & 1:
                    seen.add(sid)
                    ids.append(sid)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "g"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, below = sent.value
        for b in batches:
            prefixes = []
            for g, shared in zip(b.column(1), b.column(2)):
                s = np.asarray(g.values).view(np.uint64)
                frequent, looked = _order_parts(s, known, below)
                others = np.asarray(shared.values, dtype=np.int64).view(np.uint64)
                met = np.isin(s, others)
                wanted = prefix_size(len(s), percent) - int((looked & ~met).sum())
                # After its own: shared ones, rarest first; those not looked at, by hash; the frequent by rank.
                last = s[frequent]
                last = last[np.argsort(rank[np.searchsorted(known, last)])] if len(last) else last
                prefixes.append(np.concatenate([others, s[~looked & ~frequent], last])[: max(0, wanted)].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prefixes, pa.list_(pa.int64()))], ["sid", "g", "prefix"])

    whole = docs.select("text").mapInArrow(make, "sid long, g array<long>").dropDuplicates(["sid"])
    return whole.join(members.select("sid", "shared"), "sid").select("sid", "g", "shared").mapInArrow(order, "sid long, g array<long>, prefix array<long>")


_CLASS = "sid long, root long"


def _joiner(percent: int):
    """For the cells of one group: (sid, first sid of its class)."""

    def run(group: pa.Table) -> pa.Table:
        cell, sid = group.column("cell").to_numpy(), group.column("sid").to_numpy()
        lists = group.column("g").combine_chunks()
        values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(np.asarray(lists.value_lengths()))
        starts = np.concatenate([[0], ends[:-1]])
        order = np.lexsort((sid, cell))
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        out_sid, out_root = [], []
        for part in np.split(order, cuts):
            found = classes([values[starts[i] : ends[i]] for i in part], percent)
            out_sid.append(sid[part])
            out_root.append(sid[part][found])
        return pa.table({"sid": np.concatenate(out_sid), "root": np.concatenate(out_root)})

    return run


def _join_cells(cells: DataFrame, shingles_in_all: int, percent: int, capacity: int) -> DataFrame:
    """(sid, root) of all cells, several small cells to a group."""
    groups = max(1, -(-4 * shingles_in_all // max(1, capacity)))
    return cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("part").applyInArrow(_joiner(percent), _CLASS)


def _total(cells: DataFrame) -> int:
    return cells.agg(F.sum(F.size("g").cast("long"))).first()[0] or 0


def _in_pairs(large: DataFrame, sums: DataFrame, capacity: int) -> DataFrame:
    """The rows of cells in chunks: each pair of chunks is a cell, those within capacity stay whole. ``sums``: (cell, weight)."""
    kept = [c for c in large.columns if c != "cell"]
    n_chunks = F.when(F.col("weight") <= capacity, 1).otherwise(F.ceil(F.col("weight") * 2 / capacity).cast("int"))
    chunked = large.join(sums, "cell").withColumn("chunks", n_chunks).withColumn("own", F.pmod(F.xxhash64("sid", F.lit(99)), F.col("chunks")).cast("int"))
    pairs = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return pairs.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *kept)


def _split_large(large: DataFrame, percent: int, capacity: int) -> DataFrame:
    """(cell, sid, g): the cells over capacity in parts of which each link lies in one."""
    eps = 1 - percent / 100
    weight = F.size("g").cast("long")

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.asarray(x.values), np.asarray(y.values)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(1 - both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    done = []
    for level in range(RINGS):
        sums = materialise(large.groupBy("cell").agg(F.sum(weight).alias("weight"), F.min(F.struct(F.xxhash64("sid", F.lit(level)), "sid", "g")).alias("pivot")), "cells")
        over = sums.filter(F.col("weight") > capacity)
        done.append(large.join(sums.filter(F.col("weight") <= capacity).select("cell"), "cell", "left_semi"))
        ringed = large.join(over.select("cell", F.col("pivot.g").alias("p")), "cell").withColumn("ring", F.floor(distance(F.col("g"), F.col("p")) / eps))
        # Linked sets are at most one ring apart: each set is in its own ring and the next.
        placed = ringed.select("cell", "sid", "g", F.explode(F.array("ring", F.col("ring") + 1)).alias("ring"))
        large = materialise(placed.select(F.xxhash64("cell", F.lit(level), "ring").alias("cell"), "sid", "g"), "rings")
    # What no pivot splits goes in pairs of chunks.
    sums = materialise(large.groupBy("cell").agg(F.sum(weight).alias("weight")), "cells")
    done.append(_in_pairs(large, sums, capacity))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _finer_blocks(large: DataFrame, posted: DataFrame, percent: int, capacity: int) -> DataFrame:
    """(sid, cell): blocks of the sets (sid, g) by their sketches, which meet by shared prefix shingle (sid, p); sets that no sketch ties to another are left out."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [sketch(np.asarray(g.values).view(np.uint64)) for g in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).value_lengths().cast(pa.int64()), pa.array(drawn, pa.binary())], ["sid", "n", "bits"])

    def tie(group: pa.Table) -> pa.Table:
        cell, sid, sizes, bits = (group.column(c).combine_chunks() for c in ("cell", "sid", "n", "bits"))
        cell, sid, sizes, ties = cell.to_numpy(), sid.to_numpy(), sizes.to_numpy(), []
        order = np.lexsort((sid, cell))
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            found = near_classes(sizes[part], [bits[i].as_py() for i in part.tolist()], percent)
            tied = np.flatnonzero(found != np.arange(len(part)))
            ties.append(np.stack([sid[part[tied]], sid[part[found[tied]]]], axis=1))
        # Sets that are tied by one shingle are by others too.
        once = np.unique(np.concatenate(ties), axis=0)
        return pa.table({"a": once[:, 0], "b": once[:, 1]})

    drawn = materialise(large.mapInArrow(draw, "sid long, n long, bits binary"), "sketches")
    # In eights of bytes, as shingles are, with what a row holds beside its sketch.
    weight = (F.length("bits") / 8).cast("long") + 8
    cells = posted.select("sid", F.col("p").alias("cell")).join(drawn, "sid").select("cell", "sid", "n", "bits")
    sums = materialise(posted.select("sid", F.col("p").alias("cell")).join(drawn.select("sid", weight.alias("w")), "sid").groupBy("cell").agg(F.sum("w").alias("weight")), "cells")
    total, most = sums.agg(F.sum("weight"), F.max("weight")).first()
    if most > capacity:
        cells = _in_pairs(cells, sums, capacity)
    groups = max(1, -(-4 * total // max(1, capacity)))
    ties = cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("part").applyInArrow(tie, "a long, b long")
    return components(ties).select(F.col("node").alias("sid"), F.col("root").alias("cell"))


def classes_of_sets(docs: DataFrame, signed: DataFrame, n: int, percent: int, capacity: int, sent) -> DataFrame:
    """(sid, root): sets that link with another set, and a set that stands for their class."""
    sets = signed.filter("sid is not null").groupBy("sid").agg(F.max("n_shingles").alias("n_shingles"), F.max("looked_at").alias("looked_at"))
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    met = sets.join(_shared_shingles(docs, n, sent), "sid", "left")
    # Sets with as many shingles of their own as a prefix has are done.
    own = F.col("looked_at") - F.coalesce(F.size("shared"), F.lit(0))
    members = met.filter(own < prefix).select("sid", F.coalesce("shared", F.array().cast("array<long>")).alias("shared"))
    members = materialise(members, "shared")
    whole = materialise(_whole_sets(docs, members, n, percent, sent), "members")
    posted = whole.select("sid", F.explode("prefix").alias("p"))
    common = posted.groupBy("p").agg(F.min("sid").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("p", "lead")
    regions = materialise(posted.join(common, "p"), "regions")
    blocks = components(regions.select(F.col("sid").alias("a"), F.col("lead").alias("b"))).select(F.col("node").alias("sid"), F.col("root").alias("cell"))
    sizes = whole.select("sid", F.size("g").cast("long").alias("size"))
    weights = materialise(sizes.join(blocks, "sid").groupBy("cell").agg(F.sum("size").alias("weight")), "cells")
    total, most = weights.agg(F.sum("weight"), F.max("weight")).first()
    if total is None:
        return docs.sparkSession.createDataFrame([], _CLASS)
    whole = whole.select("sid", "g")
    if most <= capacity:
        return _join_cells(whole.join(blocks, "sid").select("cell", "sid", "g"), total, percent, capacity)
    within = blocks.join(weights.filter(F.col("weight") <= capacity).select("cell"), "cell", "left_semi")
    found = _join_cells(whole.join(within, "sid").select("cell", "sid", "g"), total, percent, capacity)
    over = materialise(blocks.join(weights.filter(F.col("weight") > capacity).select("cell"), "cell", "left_semi").select("sid"), "over")
    large = materialise(whole.join(over, "sid"), "large")
    finer = _finer_blocks(large, regions.join(over, "sid", "left_semi"), percent, capacity)
    large = materialise(large.join(finer, "sid").select("cell", "sid", "g"), "finer")
    weights = materialise(large.groupBy("cell").agg(F.sum(F.size("g").cast("long")).alias("weight")), "cells")
    total, most = weights.agg(F.sum("weight"), F.max("weight")).first()
    if total is None:
        return found
    if most <= capacity:
        return found.unionByName(_join_cells(large, total, percent, capacity))
    small = large.join(weights.filter(F.col("weight") <= capacity).select("cell"), "cell", "left_semi")
    found = found.unionByName(_join_cells(small, total, percent, capacity))
    large = large.join(weights.filter(F.col("weight") > capacity).select("cell"), "cell", "left_semi")
    parts = materialise(_split_large(large, percent, capacity), "cells")
    links = materialise(_join_cells(parts, _total(parts), percent, capacity), "links")
    return found.unionByName(components(links.select(F.col("sid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("sid"), "root"))


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT,
    capacity: int = CAPACITY, sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, class_key) of every row.

    ``key`` is ``row_key`` of the row; rows of one class, and no others, share ``class_key``.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = _frequent(narrow, n, sample)
    order = np.argsort(frequent)
    # Longer prefixes are looked for in a larger part of the hashes, or few sets would be done.
    below = np.uint64(int(min(0.99, LOOKED_AT * (100 - percent) / 10) * 2**64))
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64), below))  # at most FREQUENT entries
    signed = _sign(narrow, n, sent)
    found = materialise(classes_of_sets(narrow, signed, n, percent, capacity, sent), "classes")
    # The smallest id of each set, then of each class; both are summed up before they are shuffled.
    first = signed.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first_id")).join(found, "sid", "left")
    first = materialise(first.select("sid", "first_id", F.coalesce("root", "sid").alias("root")), "firsts")
    least = first.groupBy("root").agg(F.min("first_id").alias("component"))
    of_set = first.join(least, "root").select("sid", "root", "component")
    joined = signed.select("doc_id", "key", "n_shingles", "sid").join(of_set, "sid", "left")
    alone = F.col("sid").isNull()
    return joined.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "key", F.when(alone, F.col("key")).otherwise(F.col("root")).alias("class_key"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, one of each class: that of the smallest id (nulls last), then of the
    smallest ``row_key``; of repeated rows one stays. All columns are kept."""
    rows = jaccard_classes(docs, id_col, text_col, **options)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("key").alias("c"))
    # An empty text is a class of its own, and its key could equal a set's: they are kept apart.
    stay = rows.groupBy("class_key", (F.col("n_shingles") == 0).alias("empty")).agg(F.min(order).alias("first"))
    name = "row_key"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    keyed = docs.withColumn(name, row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(stay.select(F.col("first.c").alias(name)).distinct(), name, "left_semi").dropDuplicates([name]).drop(name)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
