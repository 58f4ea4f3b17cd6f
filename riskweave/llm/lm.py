"""Language-model scoring with a log-frequency Bloom filter.

Counts of all unigrams and bigrams of the training documents are gathered by a shuffle and quantised: counts up to ``EXACT`` are their own
level, larger ones share a level with those within a factor of ``BASE``. The filter holds the events (n-gram, 1) up to (n-gram, level). A reader probes
levels 1, 2, 3, ... until one is absent, so an error can only raise a level. A level read stands for the mean count of the n-grams that
read so, errors included. Scores use Dirichlet smoothing over the counts read back:

    P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU),  P(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

with ``c(h w)`` at most ``c(h)``. The first token follows the end token.

These are probabilities only if absent bigrams read 0: of V tokens, V times the error of level 1 are paid in error for a context. So an event of level
1 has as many probes as keep this under ``LEAK`` of MU (their number follows V), those of higher levels ``PROBES``. With filters half full an
absent n-gram is known with a chance of 1 / 2 ** probes: under LEAK * MU / V, which is 1 in 70,000 at 360,000 distinct tokens. P(. | h) then adds up to 1 but for LEAK and the
rounding of levels (tests hold it to 5 %).

The filter holds every n-gram of the training documents, those seen once included. N-grams are dealt out by
the first bits of their hash to groups, whose number follows the input; counting, quantising and building a group's bits
is one step after one shuffle. The first groups, up to ``MAX_BYTES``, are broadcast. The others stay a table: chunks of documents ask them,
one block of distinct n-grams per chunk and group, and the levels come back in the order asked. Which groups
are broadcast moves data and changes no result. The exact unigram score needs exact counts: frequent tokens (at
most ``FREQUENT`` of them) are broadcast, all other tokens ask their groups for counts too.

Where the documents learned from are among those scored (``learn_and_score``), nothing is broadcast or asked apart: a chunk's block
of distinct n-grams, with their counts in the texts learned from, goes to a group once, and the group builds its
bits of all blocks, reads every distinct n-gram from them, and answers each block. That filter is not kept.

Words are compared by 64-bit hashes, n-grams by ``GRAM_BITS``.

Cases: a null or empty text is its end token alone. Repeated rows are scored one by one and
learned from as often as they stand there; a null id counts as the empty text for the fold.
With no training row, N and V are 0 and every known count 0; the scores stay finite. An empty table gives no
rows. A task holds one text whole, and a chunk of others. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import fold, mix64, ngram_hashes, ship, space_words, table, word_hashes
from riskweave.session import materialise

EXACT = 10  # counts that are a level each
BASE = 1.08
MAX_LEVEL = 255  # counts of 1.5 billion and more
PROBES = 6  # of an event above level 1
LEAK = 0.02
MU = 250.0  # of 60 to 16,000 the best on held-out documents at 3 million training tokens
MAX_BYTES = 32 << 20  # of the filter that are broadcast
FREQUENT = 1 << 19
END = np.uint64(0x9E3779B97F4A7C15)
FLUSH = 3_000_000  # tokens counted in memory before they are handed on
CHUNK = 8 << 20  # bytes of text that ask together
GROUP_BYTES = 4_000_000  # text bytes of a group's n-grams, about
GRAM_BITS = 56
LEAST_GROUP_BITS = 8  # so that the rest of an n-gram is six bytes
MOST_GROUP_BITS = 20
BATCH_TOKENS = 400_000
ANSWERED_AT_ONCE = 6_000_000  # bytes of questions
_SECOND = 0xD1B54A32D192ED03
_UP = 1 / math.log(BASE)


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words and the end token."""
    words = space_words(text)
    return np.append(word_hashes(words), END) if words else np.array([END], dtype=np.uint64)


def bigrams_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of (previous, token) for every token; the first follows the end token. Texts may follow each other: each ends with it."""
    return ngram_hashes(np.concatenate([[END], tokens]), 2)


def gram(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash by which n-grams are compared. Unigrams are hashed once more, away from the words' own order."""
    return mix64(hashes) >> np.uint64(64 - GRAM_BITS)


def level_of(counts: np.ndarray) -> np.ndarray:
    over = EXACT + np.floor(np.log(np.maximum(counts, 1) / EXACT) * _UP + 1e-9).astype(np.int64)
    return np.minimum(np.where(counts <= EXACT, counts, over), MAX_LEVEL)


def _walks(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, step) of the probes of an event: probe i looks at ``first + i * step``."""
    first = mix64(hashes + np.uint64(level * _SECOND & 0xFFFFFFFFFFFFFFFF))
    return first, mix64(first) | np.uint64(1)


def _place(at: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
    """Bit of a probe within a group of ``size`` bits, under 2 ** 32."""
    return (((at >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)


def first_probes(types: float, mu: float = MU) -> int:
    """Probes of level 1: absent bigrams of ``types`` tokens add up to at most ``LEAK`` of ``mu``."""
    return max(PROBES, math.ceil(math.log2(max(1.0, types / (LEAK * mu)))))


def build_bits(grams: np.ndarray, levels: np.ndarray, probes: int) -> tuple[int, bytes]:
    """(size, bits) of one group, half of them set."""
    size = max(64, math.ceil((len(grams) * probes + int((levels - 1).sum()) * PROBES) / math.log(2)))
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, step = _walks(grams[levels >= level], level)
        for _ in range(probes if level == 1 else PROBES):
            bits[_place(at, np.uint64(size))] = True
            at += step
    return size, np.packbits(bits, bitorder="little").tobytes()


@dataclass
class LogBloom:
    """Bits of some of the 2 ** ``group_bits`` groups; ``first`` is -1 for those that are not here."""

    group_bits: int
    first: np.ndarray  # first byte of a group
    size: np.ndarray  # its bits
    probes: np.ndarray  # of its events of level 1
    bits: np.ndarray

    @staticmethod
    def of(group_bits: int, groups: list[tuple[int, int, int, bytes]]) -> LogBloom:
        """From (group, size, probes, bits)."""
        first, size, probes = np.full(1 << group_bits, -1), np.ones(1 << group_bits, np.int64), np.ones(1 << group_bits, np.int64)
        at = 0
        for g, n, k, bits in groups:
            first[g], size[g], probes[g] = at, n, k
            at += len(bits)
        return LogBloom(group_bits, first, size, probes, np.frombuffer(b"".join(b for *_, b in groups), dtype=np.uint8))

    def group_of(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(GRAM_BITS - self.group_bits)).astype(np.int64)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        return self.first[self.group_of(grams)] >= 0

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by probing until a level is absent; 0 if its group is not here."""
        out = np.zeros(len(grams), dtype=np.int64)
        group = self.group_of(grams)
        live = np.flatnonzero(self.first[group] >= 0)
        first, size, probes = (a[group[live]] for a in (self.first, self.size.astype(np.uint64), self.probes))
        most = int(probes.max(initial=0))
        for level in range(1, MAX_LEVEL + 1):
            at, step = _walks(grams[live], level)
            for probe in range(most if level == 1 else PROBES):
                if not len(live):
                    return out
                bit = _place(at, size)
                known = (self.bits[first + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if level == 1:
                    known |= probe >= probes
                if known.all():
                    at = at + step
                    continue
                live, at, step, first, size, probes = (a[known] for a in (live, at, step, first, size, probes))
                at += step
            out[live] = level
        return out


def _six(grams: np.ndarray) -> bytes:
    """The six lower bytes of each; the group has the rest."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _whole(six: bytes, group: int, group_bits: int) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    low = out.view("<u8").ravel() & np.uint64((1 << (GRAM_BITS - group_bits)) - 1)
    return low | (np.uint64(group) << np.uint64(GRAM_BITS - group_bits))


def _write_counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each count; those of 255 and more follow apart."""
    return np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<i8").tobytes()


def _read_counts(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


def _by_group(grams: np.ndarray, group_bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of ordered n-grams that lie in one group."""
    group = (grams >> np.uint64(GRAM_BITS - group_bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(grams)] if len(grams) else [0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield int(group[low]), slice(low, high)


@dataclass
class Model:
    """``groups`` is the written filter: (group, size, probes, bits) and the exact counts of the group's unigrams (unis, counts, large)."""

    groups: DataFrame | None
    group_bits: int
    n_tokens: int
    n_types: int
    bloom: LogBloom
    all_sent: bool
    #: Mean counts that a level read stands for, of unigrams and of bigrams.
    means: tuple[np.ndarray, np.ndarray]
    #: Ordered n-grams of the frequent tokens, their counts and the levels that the filter reads.
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray]
    all_frequent: bool
    last_sent: int

    def unigram(self, levels: np.ndarray) -> np.ndarray:
        return (self.means[0][levels] + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1))

    def bigram(self, together: np.ndarray, context: np.ndarray, low: np.ndarray, mu: float = MU) -> np.ndarray:
        """P(w | h) from the levels read of the pair and of the context, and P(w)."""
        of_context = self.means[0][context]
        return np.minimum(1.0, (np.minimum(self.means[1][together], of_context) + mu * low) / (of_context + mu))


def mean_counts(histogram: dict[int, tuple[int, int]]) -> np.ndarray:
    """What each level read stands for, from (n-grams, their counts) by true level: a level is raised by one with a chance of 1 / 2 ** PROBES."""
    n, total = np.zeros(MAX_LEVEL + 1), np.zeros(MAX_LEVEL + 1)
    for level, (grams, counts) in histogram.items():
        n[level], total[level] = grams, counts
    out, held_n, held_total = np.zeros(MAX_LEVEL + 1), 0.0, 0.0
    for level in range(1, MAX_LEVEL + 1):
        held_n, held_total = held_n / 2**PROBES + n[level], held_total / 2**PROBES + total[level]
        usual = level if level <= EXACT else EXACT * BASE ** (level - EXACT + 0.5)
        # Where next to nothing read so in training, the level's own middle.
        out[level] = held_total / held_n if held_n > 1e-6 else usual
    return out


def _count(group_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tasks hand on counted n-grams, a block for each group."""
    names = ["group", "n", "grams", "counts", "large"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for n, parts in enumerate(held, 1):
                if parts:
                    grams, c = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    rows = []
                    for g, at in _by_group(grams, group_bits):
                        rows.append((g, n, _six(grams[at]), *_write_counts(c[at])))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int8(), *[pa.binary()] * 3))], names)

        for b in batches:
            for text in b.column(0):
                tokens = tokens_of(text.as_py())
                held[0].append(gram(tokens))
                held[1].append(gram(bigrams_of(tokens)))
                size += len(tokens)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return count


def _pose(group_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block for each chunk and group: distinct n-grams, and how often the texts learned from hold each. From (part, text, learns)."""
    names = ["group", "chunk", "tokens", "counts", "large", "others", "other_counts", "other_large"]
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 6)

    def blocks(chunk: int, texts: list[np.ndarray], learns: list[bool]) -> pa.RecordBatch:
        tokens = np.concatenate(texts)
        learned = np.repeat(np.array(learns, dtype=np.uint64), [len(t) for t in texts])
        columns: list[list[dict[int, bytes]]] = []
        for hashes in (tokens, bigrams_of(tokens)):
            marked = np.sort(gram(hashes) << np.uint64(1) | learned)
            grams = marked >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            grams, counts = grams[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)
            six, (small, large) = _six(grams), _write_counts(counts)
            many = np.concatenate([[0], np.cumsum(counts >= 255)])
            columns.append([{}, {}, {}])
            for g, at in _by_group(grams, group_bits):
                a, z = at.start, at.stop
                columns[-1][0][g], columns[-1][1][g], columns[-1][2][g] = six[6 * a : 6 * z], small[a:z], large[8 * many[a] : 8 * many[z]]
        groups = sorted({*columns[0][0], *columns[1][0]})
        arrays = [pa.array(groups, types[0]), pa.array([chunk] * len(groups), types[1])]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([of.get(g, b"") for g in groups], pa.binary()) for kind in columns for of in kind)], names)

    def pose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, texts, learns = None, [], []
        for chunk, rows in _Ask.chunks(batches):
            if chunk != here and texts:
                yield blocks(here, texts, learns)
                texts, learns = [], []
            here = chunk
            texts += [tokens_of(t.as_py()) for t in rows.column("text")]
            learns += rows.column("learns").to_pylist()
        if texts:
            yield blocks(here, texts, learns)

    return pose


_GROUP_ROW = "group int, size long, probes int, bits binary, unis binary, counts binary, large binary, levels array<struct<n: int, level: int, grams: long, total: long>>"


_HISTOGRAM = pa.list_(pa.struct([("n", pa.int32()), ("level", pa.int32()), ("grams", pa.int64()), ("total", pa.int64())]))


def _fit(counted: dict[int, tuple[np.ndarray, np.ndarray]], group_bits: int, mu: float) -> tuple[int, int, bytes, list[dict]]:
    """(size, probes, bits) of a group and its histogram of levels, from the n-grams and counts by n."""
    levels, histogram = [], []
    for n, (_, counts) in counted.items():
        levels.append(level_of(counts))
        of, at = np.unique(levels[-1], return_inverse=True)
        for level, many, total in zip(of.tolist(), np.bincount(at).tolist(), np.bincount(at, counts).tolist()):
            histogram.append({"n": n, "level": level, "grams": many, "total": int(total)})
    # Hashes spread evenly: a group's tokens stand for all groups' ones.
    probes = first_probes(len(counted[1][0]) << group_bits if 1 in counted else 0, mu)
    size, bits = build_bits(np.concatenate([grams for grams, _ in counted.values()]), np.concatenate(levels), probes)
    return size, probes, bits, histogram


def _add_up(every: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams in order, their counts, place of each given one among them)."""
    grams, inverse = np.unique(every, return_inverse=True)
    return grams, np.bincount(inverse, counts, len(grams)).astype(np.int64), inverse


def _build(group_bits: int, mu: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(group: int, parts: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> tuple:
        counted = {n: _add_up(*(np.concatenate(x) for x in zip(*some)))[:2] for n, some in parts.items()}
        size, probes, bits, histogram = _fit(counted, group_bits, mu)
        unis, c = counted.get(1, (np.empty(0, np.uint64), np.empty(0, np.int64)))
        return group, size, probes, bits, _six(unis), *_write_counts(c), histogram

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, {}
        for b in batches:
            for group, n, six, small, large in zip(*(c.to_pylist() for c in b.columns)):
                if group != here:
                    if parts:
                        yield rows([finish(here, parts)])
                    here, parts = group, {}
                parts.setdefault(n, []).append((_whole(six, group, group_bits), _read_counts(small, large)))
        if parts:
            yield rows([finish(here, parts)])

    names = ["group", "size", "probes", "bits", "unis", "counts", "large", "levels"]
    types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4, _HISTOGRAM]
    rows = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
    return build


_ANSWER = "chunk long, group int, counts binary, large binary, levels binary, others binary"
_POSED = "group int, chunk long, tokens binary, counts binary, large binary, others binary, other_counts binary, other_large binary"


def _build_and_answer(group_bits: int, mu: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers to the blocks posed to a group, from the filter of what they count, and a row without a chunk for its histogram."""
    names = ["chunk", "group", "counts", "large", "levels", "others", "histogram"]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, _HISTOGRAM]

    def finish(group: int, posed: list[tuple]) -> pa.RecordBatch:
        chunks, *columns = zip(*posed)
        found, counted = [], {}
        for n, (six, small, large) in enumerate((columns[:3], columns[3:]), 1):
            found.append(_add_up(_whole(b"".join(six), group, group_bits), _read_counts(b"".join(small), b"".join(large))))
            grams, counts, _ = found[-1]
            counted[n] = grams[counts > 0], counts[counts > 0]
        size, probes, bits, histogram = _fit(counted, group_bits, mu)
        bloom = LogBloom.of(group_bits, [(group, size, probes, bits)])
        read = [bloom.levels(grams).astype(np.uint8)[inverse].tobytes() for grams, _, inverse in found]
        counts = found[0][1][found[0][2]]
        small, large = _write_counts(counts)
        many = np.concatenate([[0], np.cumsum(counts >= 255)])
        rows, a, b = [(None, group, None, None, None, None, histogram)], 0, 0
        for chunk, tokens, others in zip(chunks, columns[0], columns[3]):
            z, y = a + len(tokens) // 6, b + len(others) // 6
            rows.append((chunk, group, small[a:z], large[8 * many[a] : 8 * many[z]], read[0][a:z], read[1][b:y], None))
            a, b = z, y
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, posed = None, []
        for b in batches:
            for group, *block in zip(*(c.to_pylist() for c in b.columns)):
                if group != here and posed:
                    yield finish(here, posed)
                    posed = []
                here = group
                posed.append(block)
        if posed:
            yield finish(here, posed)

    return build


def _tasks(spark: SparkSession, group_bits: int) -> int:
    """Tasks of a step by group: four groups each, at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << group_bits) // 4)


def _group_bits(text: DataFrame) -> int:
    size = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_GROUP_BITS, max(LEAST_GROUP_BITS, math.ceil(math.log2(max(1, size / GROUP_BYTES)))))


def _histograms(levels: DataFrame) -> list[dict[int, tuple[int, int]]]:
    """(n-grams, their counts) by level, of unigrams and of bigrams, from the groups' histograms."""
    one = levels.select(F.explode(levels.columns[0]).alias("l")).groupBy("l.n", "l.level")
    rows = one.agg(F.sum("l.grams").alias("grams"), F.sum("l.total").alias("total")).collect()
    return [{r.level: (r.grams, r.total) for r in rows if r.n == n} for n in (1, 2)]


def learn(docs: DataFrame, text_col: str = "text", max_bytes: int = MAX_BYTES, frequent: int = FREQUENT, mu: float = MU) -> Model:
    """Filter and exact unigram counts of the documents; ``mu`` is the smoothing that the filter's errors are held to."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    group_bits = _group_bits(text)
    counted = text.mapInArrow(_count(group_bits), "group int, n tinyint, grams binary, counts binary, large binary")
    by_group = counted.repartition(_tasks(spark, group_bits), "group").sortWithinPartitions("group")
    groups = materialise(by_group.mapInArrow(_build(group_bits, mu), _GROUP_ROW), "filter")
    histograms = _histograms(groups.select("levels"))
    n_types, n_tokens = (sum(v[i] for v in histograms[0].values()) for i in (0, 1))
    # The first groups that fit are broadcast.
    sizes = groups.select("group", F.octet_length("bits").alias("bytes")).orderBy("group").collect()  # a row per group
    upto, sent = 0, []
    for r in sizes:
        upto += r.bytes
        if upto > max_bytes:
            break
        sent.append(r.group)
    here = groups.filter(F.col("group") <= sent[-1]).select("group", "size", "probes", "bits").toArrow().to_pydict() if sent else {}
    bloom = LogBloom.of(group_bits, list(zip(*here.values())))
    top, least = 0, MAX_LEVEL + 1
    for level in sorted(histograms[0], reverse=True):
        top += histograms[0][level][0]
        if top > frequent:
            break
        least = level

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, size, probes, bits, six, small, large in zip(*(c.to_pylist() for c in b.columns)):
                c = _read_counts(small, large)
                keep = level_of(c) >= least
                tokens = _whole(six, group, group_bits)[keep]
                read = LogBloom.of(group_bits, [(group, size, probes, bits)]).levels(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(c[keep]), pa.array(read)], ["gram", "c", "level"])

    found = groups.select("group", "size", "probes", "bits", "unis", "counts", "large").mapInArrow(often, "gram long, c long, level long").toArrow()  # at most ``frequent`` rows
    grams = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    top_tokens = (grams[order], found.column("c").to_numpy()[order], found.column("level").to_numpy()[order])
    means = (mean_counts(histograms[0]), mean_counts(histograms[1]))
    return Model(groups, group_bits, n_tokens, n_types, bloom, len(sent) == len(sizes), means, top_tokens, len(grams) == n_types, sent[-1] if sent else -1)


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the ordered ``known``, whether the asked is there)."""
    if not len(known):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def _asks(tokens: np.ndarray, pairs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's distinct tokens are not frequent, and which bigrams' groups are not here."""
    return ~_find(model.frequent[0], tokens)[1], np.zeros(len(pairs), dtype=bool) if model.all_sent else ~model.bloom.holds(pairs)


class _Ask:
    """Chunks of the numbered rows, and what they ask."""

    def __init__(self, shared) -> None:
        self.shared = shared

    @staticmethod
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(chunk, rows): runs of rows of up to ``CHUNK`` bytes of text; a chunk is numbered within its ``part``, the partition that was read."""
        number, held = None, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            start = 0
            for i, size in enumerate(sizes):
                if number is None:
                    number = b.column("part")[0].as_py() << 32
                if held and held + size > CHUNK:
                    if i > start:
                        yield number, b.slice(start, i - start)
                    start, held, number = i, 0, number + 1
                held += size
            if len(sizes) > start:
                yield number, b.slice(start)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, texts = None, []
        for chunk, rows in self.chunks(batches):
            if chunk != here and texts:
                yield from self.blocks(here, texts)
                texts = []
            here = chunk
            texts += [tokens_of(t.as_py()) for t in rows.column("text")]
        if texts:
            yield from self.blocks(here, texts)

    def blocks(self, chunk: int, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        model = self.shared.value
        every = np.concatenate(texts)
        distinct = np.unique(gram(every)), np.unique(gram(bigrams_of(every)))
        questions = [d[asks] for d, asks in zip(distinct, _asks(*distinct, model))]
        asked = [dict(_by_group(q, model.group_bits)) for q in questions]
        rows = []
        for g in sorted({*asked[0], *asked[1]}):
            blocks = [_six(q[of[g]]) if g in of else b"" for q, of in zip(questions, asked)]
            rows.append((g, chunk, *blocks))
        if rows:
            types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["group", "chunk", "tokens", "others"])


def _answers(numbered: DataFrame, model: Model, shared) -> DataFrame:
    """Per chunk and group asked: counts and levels of the tokens, levels of the other n-grams, in the order asked."""
    group_bits = model.group_bits

    types = (pa.int64(), pa.int32(), *[pa.binary()] * 4)

    def together(group: int, held: tuple | None, pending: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        """All questions of some chunks to one group, looked up at once."""
        tokens, others = ([_whole(p[i], group, group_bits) for p in pending] for i in (1, 2))
        every = np.concatenate([*tokens, *others])
        counts, levels = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        if held is not None:  # a group without a row has no n-grams
            bloom, unis, c = held
            at, known = _find(unis, every)
            counts[known] = c[at[known]]
            levels = levels if bloom is None else bloom.levels(every)
        cuts = np.cumsum([len(x) for x in (*tokens, *others)])[:-1]
        n = len(pending)
        counts, levels = np.split(counts, cuts), np.split(levels.astype(np.uint8), cuts)
        rows = [(p[0], group, *_write_counts(counts[i]), levels[i].tobytes(), levels[n + i].tobytes()) for i, p in enumerate(pending)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["chunk", "group", "counts", "large", "levels", "others"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, pending, size = None, None, [], 0
        for b in batches:
            for group, chunk, tokens, others, bits_size, probes, bits, six, small, large in zip(*(x.to_pylist() for x in b.columns)):
                if pending and (group != here or size > ANSWERED_AT_ONCE):
                    yield together(here, held, pending)
                    pending, size = [], 0
                if group != here:
                    here, held = group, None
                if chunk < 0:  # a group comes before what it is asked; those that are broadcast come without bits
                    bloom = None if bits is None else LogBloom.of(group_bits, [(group, bits_size, probes, bits)])
                    held = bloom, _whole(six, group, group_bits), _read_counts(small, large)
                else:
                    pending.append((chunk, tokens, others))
                    size += len(tokens) + len(others)
        if pending:
            yield together(here, held, pending)

    asked = numbered.select("text", F.spark_partition_id().alias("part")).mapInArrow(_Ask(shared), "group int, chunk long, tokens binary, others binary")
    nothing = {"size": "long", "probes": "int", "bits": "binary", "unis": "binary", "counts": "binary", "large": "binary"}
    asked = asked.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    none = F.lit(None).cast("binary")
    away = model.groups.withColumn("bits", F.when(F.col("group") > model.last_sent, F.col("bits")))
    kept = away.select("group", F.lit(-1).cast("long").alias("chunk"), none.alias("tokens"), none.alias("others"), *nothing)
    # A group and its questions pass by in order: one group is held at a time, however many ask it.
    dealt = kept.unionByName(asked).repartition(_tasks(numbered.sparkSession, group_bits), "group").sortWithinPartitions("group", "chunk")
    return dealt.mapInArrow(answer, _ANSWER)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, mu: float = MU, as_stored: bool = False
) -> DataFrame:
    """Per document: tokens, known tokens, exact unigram score, model score.

    Documents are read twice where groups are asked, and must be the same rows in the same order: frames are written first, unless
    they are ``as_stored``, the rows of a table as it is.
    """
    spark = docs.sparkSession
    ship(spark)
    numbered = _rows(docs, id_col, text_col, keep)
    shared = spark.sparkContext.broadcast(replace(model, groups=None))
    if model.all_sent and model.all_frequent:
        rater = _Rate(shared, mu, numbered.columns[1:])
        return _finished(numbered.mapInArrow(rater.rows, _rated(numbered)), numbered, model)
    numbered = numbered if as_stored else materialise(numbered, "lm-rows")
    return _by_chunk(numbered, _answers(numbered, model, shared), model, shared, mu)


def learn_and_score(
    docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None, mu: float = MU, as_stored: bool = False
) -> DataFrame:
    """What ``score`` gives for the documents, with the filter of those that ``learns`` marks. One shuffle of n-grams both counts and asks."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs if as_stored else materialise(docs, "lm-rows")
    text = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    group_bits = _group_bits(text)
    posed = text.select(F.spark_partition_id().alias("part"), "text", "learns").mapInArrow(_pose(group_bits), _POSED)
    by_group = posed.repartition(_tasks(spark, group_bits), "group").sortWithinPartitions("group")
    histogram = "histogram array<struct<n: int, level: int, grams: long, total: long>>"
    answered = materialise(by_group.mapInArrow(_build_and_answer(group_bits, mu), f"{_ANSWER}, {histogram}"), "answers")
    histograms = _histograms(answered.filter("chunk is null").select("histogram"))
    n_types, n_tokens = (sum(v[i] for v in histograms[0].values()) for i in (0, 1))
    nobody = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    means = (mean_counts(histograms[0]), mean_counts(histograms[1]))
    model = Model(None, group_bits, n_tokens, n_types, LogBloom.of(group_bits, []), False, means, nobody, False, -1)
    answers = answered.filter("chunk is not null").drop("histogram")
    return _by_chunk(_rows(docs, id_col, text_col, keep), answers, model, spark.sparkContext.broadcast(model), mu)


_MADE = ["n_tokens", "n_known", "base_score", "score"]


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: dict[str, Column] | None) -> DataFrame:
    kept = [v.alias(k) for k, v in (keep or {id_col: F.col(id_col)}).items()]
    return docs.select(F.col(text_col).cast("string").alias("text"), *kept)


def _rated(numbered: DataFrame) -> str:
    return "n_tokens long, n_known long, base_score double, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[1:])


def _finished(rated: DataFrame, numbered: DataFrame, model: Model) -> DataFrame:
    return rated.select(*numbered.columns[1:], "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


class _Rate:
    """Scores of rows (text and ``names``), from what is broadcast and, by chunk, what is answered."""

    def __init__(self, shared, mu: float, names: list[str]) -> None:
        self.shared, self.mu, self.names = shared, mu, names

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without questions, a bounded number of tokens at a time."""
        for b in batches:
            start, texts, held = 0, [], 0
            for i, text in enumerate(b.column(0)):
                texts.append(tokens_of(text.as_py()))
                held += len(texts[-1])
                if held >= BATCH_TOKENS or i + 1 == b.num_rows:
                    yield self.scored(b.columns[1:], start, texts)
                    start, texts, held = i + 1, [], 0

    def chunk(self, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.Table.from_batches([b for block in blocks.sort_by("place").column("rows") for b in pa.ipc.open_stream(block.as_buffer())])
        texts = [tokens_of(t.as_py()) for t in rows.column(0)]
        answers = answers.sort_by("group")
        small, large, levels, others = (b"".join(answers.column(c).to_pylist()) for c in ("counts", "large", "levels", "others"))
        read = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (levels, others))
        return pa.Table.from_batches([self.scored([c.combine_chunks() for c in rows.columns[1:]], 0, texts, (_read_counts(small, large), *read))])

    def scored(self, kept: list[pa.Array], start: int, texts: list[np.ndarray], answers: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
        """Of the texts of the rows from ``start``. Answers: counts and levels of the tokens asked, levels of the other n-grams, in order."""
        m = self.shared.value
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate(texts)
        tokens, inverse = np.unique(gram(every), return_inverse=True)
        pairs, of_pair = np.unique(gram(bigrams_of(every)), return_inverse=True)
        pair_levels, read, count = m.bloom.levels(pairs), m.bloom.levels(tokens), np.zeros(len(tokens), dtype=np.int64)
        at, often = _find(m.frequent[0], tokens)
        count[often], read[often] = m.frequent[1][at[often]], m.frequent[2][at[often]]
        if answers is not None:
            counts, levels, others = answers
            asked, asked_pairs = _asks(tokens, pairs, m)
            if len(counts) != asked.sum() or len(others) != asked_pairs.sum():
                raise RuntimeError("the documents changed between two readings")
            count[asked] = counts
            read[asked] = np.where(m.bloom.holds(tokens[asked]), read[asked], levels)  # groups that are broadcast answer no level
            pair_levels[asked_pairs] = others
        floor = math.log10(m.n_tokens + 0.5 * (m.n_types + 1))
        known, base, low = (count > 0).astype(np.int64), np.log10(count + 0.5) - floor, m.unigram(read)
        by_text = [np.empty(len(texts), kind) for kind in (np.int64, np.float64, np.float64)]
        ends, a = np.cumsum(sizes), 0
        while a < len(texts):  # a bounded number of tokens at a time
            z = max(a + 1, int(np.searchsorted(ends, starts[a] + BATCH_TOKENS, "right")))
            here = inverse[starts[a] : ends[z - 1]]
            before = np.append(inverse[starts[a] - 1], here[:-1])  # each text ends with the end token, the last one too
            p = m.bigram(pair_levels[of_pair[starts[a] : ends[z - 1]]], read[before], low[here], self.mu)
            for out, v in zip(by_text, (known[here], base[here], np.log10(p))):
                out[a:z] = np.add.reduceat(v, starts[a:z] - starts[a])
            a = z
        return pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int64)), *map(pa.array, by_text), *(c.slice(start, len(texts)) for c in kept)], [*_MADE, *self.names])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as compressed blocks of their rows."""
    for place, (chunk, rows) in enumerate(_Ask.chunks(batches)):
        rows = pa.RecordBatch.from_arrays(rows.columns[1:], rows.schema.names[1:])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([place]), pa.array([out.getvalue().to_pybytes()])], ["chunk", "place", "rows"])


def _by_chunk(numbered: DataFrame, answers: DataFrame, model: Model, shared, mu: float) -> DataFrame:
    """Scores of the chunks of rows, each with what it was answered."""
    rater = _Rate(shared, mu, numbered.columns[1:])
    chunks = numbered.select(F.spark_partition_id().alias("part"), "*").mapInArrow(_deal, "chunk long, place long, rows binary")
    # One function per frame: Spark tells Arrow's ways of grouping by the arguments it is given.
    rated = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda blocks, found: rater.chunk(blocks, found), _rated(numbered))
    return _finished(rated, numbered, model)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    return learn_and_score(docs, ~held_out, keep={"doc_id": F.col("doc_id"), "held_out": held_out}, as_stored=True)
