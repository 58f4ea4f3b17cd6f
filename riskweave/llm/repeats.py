"""Removal of repeated byte strings, by a run-length Burrows-Wheeler index.

A byte goes if it lies in a string of ``LENGTH`` (100) bytes that also starts earlier: in a document with a
smaller id, or earlier in the same one. Overlaps count, and strings are judged on the
input. The way there:

1. Every string of 100 bytes picks the smallest-hashed of its 20-byte pieces as its anchor (by the upper bits of the hash, the
   first of equals). Equal strings pick equal anchors. The strings that pick one anchor place start next to each other,
   so a document is a row per anchor and not a row per byte.
2. Anchors that occur once stand for strings that occur once. Only the others go on, with
   the bytes around them, dealt out by anchor; equal stretches of one task are sent once.
3. Equal stretches are one, and one that is alone with its anchor matches no other. Of the
   others, part by part, the earliest few (``FIRST``) of each anchor are indexed: a Burrows-Wheeler transform, kept as runs with the text places of the run ends.
   All later stretches are streamed backwards through the runs for their matching statistics; starts that match for 100 bytes
   or more are not the earliest. What is left of them goes the same way again, with more stretches of each anchor
   in the index (``GROWTH`` times as many), until nothing is left. Of equal strings among the indexed stretches, neighbours in the order of suffixes, the earliest stays.
4. In a document, the strings at repeated anchors that are not the earliest are removed.

The index is by part and bounded (``PART_BYTES``), as a single one over all documents would
have to be built in one task. An anchor with more than ``HOT`` places (a passage that many
documents share) could still give too many different stretches for one part: there, each string is
dealt out by its own hash.

Cases: null and empty texts have no bytes and lose none; nor do texts under 100 bytes. Rows
of equal id and text are one document and get equal results. Of several texts under one id the order is that of
their hashes; null ids come first. Very long texts are worked through in pieces of starts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import ship, table
from riskweave.session import materialise

LENGTH = 100
PIECE = 20
CHUNK = 1 << 21  # bytes worked on at a time
BLOCK = 1 << 15  # starts whose hashes stay in a core's cache
PLACE_BITS = 20  # of a hash that give way to the place in a block
PART_BYTES = 3 << 20  # bytes of stretches that one index holds, about
FIRST, GROWTH = 4, 64  # stretches of an anchor that the first index holds, and how many times more each further one
HOT = 10_000  # places of an anchor beyond which strings are dealt out one by one
_B = np.uint64(0x9E3779B97F4A7C15)


def piece_hashes(data: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of the ``piece`` bytes from each place."""
    if len(data) < piece:
        return np.empty(0, dtype=np.uint64)
    power, size, done, out = _B, 1, 0, None
    h = data.astype(np.uint64) + np.uint64(1)
    factor = np.uint64(1)
    # Hashes of 1, 2, 4, ... bytes; those of the binary digits of ``piece`` are put together.
    while True:
        if piece & size:
            part = h[done : done + len(data) - piece + 1]
            out = part.copy() if out is None else out * power + part
            done += size
        if size * 2 > piece:
            break
        h = h[:-size] * power + h[size:]
        power, size = np.uint64(int(power) ** 2 % (1 << 64)), size * 2
    return _mixed(out)


def _mixed(out: np.ndarray) -> np.ndarray:
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of the ``width`` values from each place, up to 2 ** ``PLACE_BITS`` values.

    Values count without their lower bits, the same for any number of values; places stand there instead, so one minimum finds both.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, size = values & ~low | np.arange(len(values), dtype=np.uint64), 1
    while size * 2 <= width:
        least = np.minimum(least[size:], least[:-size])
        size *= 2
    if size < width:
        least = np.minimum(least[width - size :], least[: size - width])
    return (least & low).astype(np.int64)


def anchors(data: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of each anchor of one document."""
    empty = np.empty(0, dtype=np.int64)
    out: list[tuple] = []
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        found = []
        for block in range(0, len(part) - length + 1, BLOCK):
            h = piece_hashes(part[block : block + BLOCK + length - 1], piece)
            at = _first_smallest(h, length - piece + 1)
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            found.append((h[at[cuts]], at[cuts] + block, cuts + block))
        h, at, cuts = (np.concatenate(x) for x in zip(*found))
        # An anchor may go on in the next block.
        new = np.concatenate([[True], at[1:] != at[:-1]])
        h, at, cuts = h[new], at[new], cuts[new]
        ends = np.append(cuts[1:], len(part) - length + 1) - 1
        out.append((h, at + begin, cuts + begin, ends + begin))
    if not out:
        return np.empty(0, dtype=np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (the text has eight more than are asked for), as one number; no copy."""
    return np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))


def common_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes are equal from the places in both texts (as words), up to ``limit`` each."""
    out = limit.astype(np.int64)
    live, step = np.flatnonzero(limit > 0), 0
    while len(live):
        differ = a[at_a[live] + step] ^ b[at_b[live] + step]
        low = np.flatnonzero(differ)
        bit = differ[low] & (~differ[low] + np.uint64(1))
        equal = step + (np.frexp(bit.astype(np.float64))[1] - 1 >> 3)
        out[live[low]] = np.minimum(equal, limit[live[low]])
        step += 8
        live = live[differ == 0]
        live = live[limit[live] > step]
    return out


class RunIndex:
    """Run-length Burrows-Wheeler transform of several stretches, each with an end of its own.

    ``run_start``: first row of each run; ``run_step``: where a run's first row leads, one byte
    back; ``run_kind``: its byte plus 1 (0: an end); ``run_first``, ``run_place``: text places of the run's first and last row.
    ``firsts``: the first place of each string of ``length`` bytes, in order.
    """

    def __init__(self, stretches: list[bytes], length: int = LENGTH):
        self.sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        self.n = len(stretches)
        text = np.frombuffer(b"\0".join(stretches) + b"\0", dtype=np.uint8)
        ends = np.cumsum(self.sizes + 1) - 1
        to_end = np.repeat(ends, self.sizes + 1) - np.arange(len(text))
        self.to_end, self.words = to_end, _words(np.concatenate([text, np.zeros(8, dtype=np.uint8)]))
        rows = self._sorted(text, to_end, int(self.sizes.max()))
        # Byte 0 of a text is told from an end by its class: ends come first of all.
        kind = text[rows - 1].astype(np.int16) + 1
        kind[(rows == 0) | (to_end[rows - 1] == 0)] = 0
        first = np.concatenate([[True], kind[1:] != kind[:-1]])
        self.run_start = np.flatnonzero(first)
        run_size = np.diff(np.append(self.run_start, len(kind)))
        run_kind = kind[self.run_start]
        # Rows that begin with one byte follow each other, in the order of the runs.
        before = np.zeros(258, dtype=np.int64)
        before[1:] = np.cumsum(np.bincount(kind, minlength=257))
        order = np.argsort(run_kind, kind="stable")
        within = np.cumsum(run_size[order]) - run_size[order]
        self.run_step = np.empty(len(order), dtype=np.int64)
        self.run_step[order] = within
        self.run_end = self.run_start + run_size - 1
        self.run_first, self.run_place = rows[self.run_start], rows[self.run_end]
        self.run_kind = run_kind.astype(np.int64)
        self.kind_runs = self.run_kind[order] * len(order) + order  # runs by byte, then in order
        # The first place of each block of rows that share ``length`` bytes.
        firsts = np.minimum.reduceat(rows, self._blocks(rows, length))
        self.ends, self.firsts = ends, np.sort(firsts[to_end[firsts] >= length])

    @staticmethod
    def _sorted(text: np.ndarray, to_end: np.ndarray, longest: int) -> np.ndarray:
        """Places in the order of their suffixes (each up to its end, then by place).

        A rank is the place of a group's first member; only groups of several go on to be told apart.
        """
        n = len(text)
        code = np.zeros(256, dtype=np.int64)
        present = np.unique(text[to_end > 0])
        code[present] = np.arange(1, len(present) + 1)
        bits = max(1, int(len(present)).bit_length())
        # As many bytes as fit a word, ends first; words of 1, 2, 4, ... bytes are put together.
        word, depth = np.where(to_end > 0, code[text], 0), 1
        while depth < min(63 // bits, longest):
            more = min(depth, 63 // bits - depth)
            after = np.zeros(n, dtype=np.int64)
            after[: n - depth] = word[depth:] >> bits * (depth - more)
            after[to_end < depth] = 0
            word, depth = word << bits * more | after, depth + more
        rank, active, key = np.zeros(n, dtype=np.int64), np.arange(n), word
        width = int(n + 1).bit_length()
        parts = 3 if 3 * width <= 63 else 2
        while True:
            order = np.argsort(key)
            found, ordered, old = active[order], key[order], rank[active[order]]
            at = np.arange(len(order))
            cut = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            group = np.concatenate([[True], old[1:] != old[:-1]])
            rank[found] = old + np.maximum.accumulate(np.where(cut, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            active = np.sort(found[~(cut & np.append(cut[1:], True))])
            if depth >= longest or not len(active):
                break
            key = rank[active]
            for step in range(depth, depth * parts, depth):
                inside = to_end[active] >= step
                key = key << width | np.where(inside, rank[np.where(inside, active + step, 0)] + 1, 0)
            depth *= parts
        rows = np.empty(n, dtype=np.int64)
        single = np.ones(n, dtype=bool)
        single[active] = False
        rows[rank[single]] = np.flatnonzero(single)
        tied = np.sort(rank[active] << 32 | active)
        first = np.concatenate([[True], tied[1:] >> 32 != tied[:-1] >> 32]) if len(tied) else np.empty(0, dtype=bool)
        at = np.arange(len(tied))
        rows[(tied >> 32) + at - np.maximum.accumulate(np.where(first, at, 0))] = tied & 0xFFFFFFFF
        return rows

    def _blocks(self, rows: np.ndarray, length: int) -> np.ndarray:
        """Rows that share fewer than ``length`` bytes with the row before."""
        shared = np.zeros(len(rows), dtype=bool)
        long_enough = self.to_end[rows] >= length
        at = np.flatnonzero(long_enough[1:] & long_enough[:-1]) + 1
        for step in [*range(0, length - 8, 8), max(0, length - 8)]:
            at = at[self.words[rows[at] + step] == self.words[rows[at - 1] + step]] if length >= 8 else at
        if length < 8:
            at = at[common_bytes(self.words, rows[at], self.words, rows[at - 1], np.full(len(at), length)) >= length]
        shared[at] = True
        return np.flatnonzero(~shared)

    def statistics(self, stretches: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stretch, start in it, bytes from there that occur in the index, up to ``length``), one step back at a time.

        A row stands for the longest match so far. Where its byte is the next one of a stretch, it steps back;
        else the nearest runs of that byte above and below are tried at their sampled ends, and the longer match goes on.
        A match grows by one byte a step, so a stretch is left where what remains of it can no longer reach ``length``.
        """
        sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        text = np.frombuffer(b"\0".join(stretches) + b"\0" * 9, dtype=np.uint8)
        words = _words(text)
        live = np.arange(len(sizes))
        row, matched = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        n_runs = len(self.run_start)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            more = sizes >= step
            if step > 1:
                more &= matched + sizes - step + 1 >= length
            if not more.all():
                live, sizes, ends, row, matched = live[more], sizes[more], ends[more], row[more], matched[more]
            if not len(live):
                return
            kind = text[ends - step].astype(np.int64) + 1
            run = np.searchsorted(self.run_start, row, "right") - 1
            lost = np.flatnonzero(self.run_kind[run] != kind)
            if len(lost):
                at = np.searchsorted(self.kind_runs, kind[lost] * n_runs + run[lost])
                best, chosen = np.full(len(lost), -1), np.zeros(len(lost), dtype=np.int64)
                limit = np.minimum(length, step - 1)
                for near, places, last in ((at - 1, self.run_place, True), (at, self.run_first, False)):
                    good = np.flatnonzero((near >= 0) & (near < n_runs))
                    good = good[self.kind_runs[near[good]] // n_runs == kind[lost[good]]]
                    r = self.kind_runs[near[good]] % n_runs
                    place = places[r]
                    both = common_bytes(words, ends[lost[good]] - step + 1, self.words, place, np.minimum(limit, self.to_end[place]))
                    better = both > best[good]
                    best[good[better]] = both[better]
                    chosen[good[better]] = (self.run_end[r] if last else self.run_start[r])[better]
                some = best >= 0
                row[lost[some]], matched[lost] = chosen[some], best
                run[lost[some]] = np.searchsorted(self.run_start, chosen[some], "right") - 1
                stays = np.ones(len(row), dtype=bool)
                stays[lost[~some]] = False  # a byte that the index does not hold: nothing matches
            else:
                stays = np.ones(len(row), dtype=bool)
            row = np.where(stays, self.run_step[run] + row - self.run_start[run], row)
            matched = np.minimum(matched + 1, length)
            if step >= length:
                yield live, sizes - step, matched.copy()  # the next step changes it


def _earliest(index: RunIndex) -> list[np.ndarray]:
    """For each indexed stretch the starts whose string occurs in none before."""
    of = np.searchsorted(index.ends, index.firsts)
    begins = index.ends - index.sizes
    return np.split(index.firsts - begins[of], np.searchsorted(of, np.arange(1, index.n)))


def earliest(stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, in order of place, the starts whose string occurs in none before."""
    return _earliest(RunIndex(stretches, length))


def unmatched(index: RunIndex, stretches: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch the starts whose string does not occur in the index, by matching statistics."""
    n_starts = np.array([len(s) - length + 1 for s in stretches], dtype=np.int64)
    first = np.cumsum(n_starts) - n_starts
    alone = np.ones(int(n_starts.sum()), dtype=bool)
    for which, start, matched in index.statistics(stretches, length):
        full = matched >= length
        alone[first[which[full]] + start[full]] = False
    return [np.flatnonzero(x) for x in np.split(alone, first[1:])] if stretches else []


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of successive numbers."""
    if not len(values):
        return values, values
    cuts = np.flatnonzero(np.diff(values) != 1)
    return values[np.concatenate([[0], cuts + 1])], values[np.append(cuts, len(values) - 1)]


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's starts and place in one number: starts from, how many more, place after the first."""
    return first << 20 | (last - first) << 10 | place - first


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = packed >> 20
    return first + (packed & 1023), first, first + (packed >> 10 & 1023)


def _data(column: pa.Array) -> Iterator[np.ndarray]:
    """Bytes of each text, null as none; no copies."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    for i in range(len(column)):
        yield raw[offsets[i] : offsets[i + 1]]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, spot) of all documents. Short documents are worked on together."""
    for b in batches:
        docs = b.column(0).to_numpy()
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            joined = np.concatenate([d for _, d in held])
            h, place, first, last = anchors(joined)
            # Strings must not cross documents: starts are cut to those of each document.
            begins = np.cumsum([0] + [len(d) for _, d in held])
            low, high = np.searchsorted(begins, first, "right") - 1, np.searchsorted(begins, last, "right") - 1
            out = []
            for k in range(int((high - low).max()) + 1 if len(h) else 0):
                of = low + k
                some = np.flatnonzero(of <= high)
                of = of[some]
                f = np.maximum(first[some], begins[of])
                t = np.minimum(last[some], begins[of + 1] - LENGTH)
                good = f <= t
                out.append((h[some][good], of[good], place[some][good] - begins[of[good]], f[good] - begins[of[good]], t[good] - begins[of[good]]))
            hs, of, p, f, t = (np.concatenate(x) for x in zip(*out)) if out else [np.empty(0, np.int64)] * 5
            ids = np.array([i for i, _ in held], dtype=np.int64)[of.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(hs.astype(np.uint64).view(np.int64)), pa.array(ids), pa.array(_pack(p, f, t))], ["anchor", "doc", "spot"])

        for doc, data in zip(docs, _data(b.column(1))):
            if len(data) < LENGTH:
                continue
            held.append((doc, data))
            size += len(data)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        yield from flush()


def _cut_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stretch, doc, start) around the repeated anchors (doc, text, spots, hot)."""
    schema = pa.schema([("key", pa.int64()), ("stretch", pa.binary()), ("doc", pa.int64()), ("start", pa.int64())])
    seen: dict[bytes, tuple[int, int, int]] = {}
    held = 0

    def out() -> pa.RecordBatch:
        rows = [(key, s, doc, start) for s, (key, doc, start) in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for b in batches:
        for doc, data, spots, hot in zip(b.column(0).to_pylist(), _data(b.column(1)), b.column(2), b.column(3)):
            place, first, last = _unpack(np.asarray(spots.values))
            raw = data.tobytes()
            keys = _keys_at(data, place)
            for key, f, t, one_by_one in zip(keys.tolist(), first.tolist(), last.tolist(), hot.values.to_pylist()):
                for a, z in [(x, x) for x in range(f, t + 1)] if one_by_one else [(f, t)]:
                    s = raw[a : z + LENGTH]
                    k = int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) if one_by_one else key
                    known = seen.get(s)
                    if known is None:
                        seen[s] = (k, doc, a)
                        held += len(s) + 200
                    elif (doc, a) < known[1:]:
                        seen[s] = (k, doc, a)
            if held > 64 << 20:
                yield out()
                seen.clear()
                held = 0
    if seen:
        yield out()


def _keys_at(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of the anchors' pieces, as found before."""
    return piece_hashes_of(data[place[:, None] + np.arange(PIECE)]).view(np.int64)


def piece_hashes_of(pieces: np.ndarray) -> np.ndarray:
    """piece_hashes of rows that are one piece each: the bytes plus one are digits to the base ``_B``."""
    powers = np.cumprod(np.append(np.uint64(1), np.full(pieces.shape[1] - 1, _B)), dtype=np.uint64)[::-1]
    return _mixed(((pieces.astype(np.uint64) + np.uint64(1)) * powers).sum(axis=1, dtype=np.uint64))


def _keep_earliest(part: pa.Table) -> pa.Table:
    """(doc, first, last): starts of strings that occur nowhere earlier, of one part's stretches."""
    docs, firsts, lasts = [], [], []

    def keep(doc: int, start: int, found: np.ndarray) -> None:
        a, z = _runs(found + start) if len(found) and found[-1] - found[0] >= len(found) else (found[:1] + start, found[-1:] + start)
        docs.extend([doc] * len(a))
        firsts.extend(a.tolist())
        lasts.extend(z.tolist())

    rows = zip(*(part.column(c).to_pylist() for c in ("key", "stretch", "doc", "start")))
    indexed = FIRST
    while rows:
        first_of: dict[bytes, tuple[int, int]] = {}
        key_of: dict[bytes, int] = {}
        for key, s, doc, start in rows:
            known = first_of.get(s)
            if known is None or (doc, start) < known:
                first_of[s] = (doc, start)
                key_of[s] = key
        # Equal strings have one anchor: a stretch that is alone with its anchor matches no other one.
        company = Counter(key_of.values())
        taken: Counter[int] = Counter()
        index, others = [], []
        for s in sorted(first_of, key=first_of.__getitem__):
            doc, start = first_of[s]
            key = key_of[s]
            if company[key] == 1:
                keep(doc, start, np.arange(len(s) - LENGTH + 1))
                continue
            taken[key] += 1
            (index if taken[key] <= indexed else others).append(s)
        rows = []
        if not index:
            break
        runs = RunIndex(index)
        for s, found in zip(index, _earliest(runs)):
            keep(*first_of[s], found)
        # Every indexed stretch of an anchor starts before all others of that anchor: what matches is not the earliest.
        for s, found in zip(others, unmatched(runs, others)):
            doc, start = first_of[s]
            if len(found) == len(s) - LENGTH + 1:
                rows.append((key_of[s], s, doc, start))
                continue
            for a, z in zip(*(x.tolist() for x in _runs(found))):
                rows.append((key_of[s], s[a : z + LENGTH], doc, start + a))
        indexed *= GROWTH
    return pa.table({"doc": pa.array(docs, pa.int64()), "first": pa.array(firsts, pa.int64()), "last": pa.array(lasts, pa.int64())})


def removed_spans(spots: np.ndarray, keep_first: np.ndarray, keep_last: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans (half open, merged) covered by strings at repeated anchors that are not kept."""
    if not len(spots):
        return []
    _, first, last = _unpack(spots)
    # Bounds of both kinds of ranges in order: how many of each lie over what follows a bound.
    at = np.concatenate([first, last + 1, keep_first, keep_last + 1])
    order = np.argsort(at, kind="stable")
    n, k = len(first), len(keep_first)
    found, kept = (np.cumsum(np.repeat(steps, [n, n, k, k])[order]) for steps in ([1, -1, 0, 0], [0, 0, 1, -1]))
    at = at[order]
    gone = np.flatnonzero((found[:-1] > 0) & (kept[:-1] == 0) & (at[1:] > at[:-1]))
    if not len(gone):
        return []
    begins, ends = at[gone], at[gone + 1] - 1 + LENGTH
    apart = begins[1:] > ends[:-1]
    return list(zip(begins[np.append(True, apart)].tolist(), ends[np.append(apart, True)].tolist()))


_LEFT = "struct<n_bytes: bigint, spans: array<struct<from: bigint, until: bigint>>, kept: binary>"


def _apply(texts: pa.Array, spots: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    """Bytes, removed spans and what stays of each text; null where the text is."""
    kind = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))), ("kept", pa.binary())])
    out, none = [], np.empty(0, dtype=np.int64)
    for text, *found in zip(texts, spots, firsts, lasts):
        if not text.is_valid:
            out.append(None)
            continue
        raw, at, parts = text.as_py().encode("utf-8", "surrogatepass"), 0, []
        spans = removed_spans(*(none if x.values is None else np.asarray(x.values) for x in found))
        for a, z in spans:
            parts.append(raw[at:a])
            at = z
        parts.append(raw[at:])
        out.append({"n_bytes": len(raw), "spans": [{"from": a, "until": z} for a, z in spans], "kept": b"".join(parts)})
    return pa.array(out, kind)


def _in_order(texts: DataFrame) -> DataFrame | None:
    """Numbers in document order for each (doc_id, text hash), if ids alone are not enough."""
    keys = texts.select("doc_id", F.xxhash64("text").alias("hash"))
    plain = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if not plain.take(1):
        return None
    unique = materialise(keys.distinct(), "document-keys")
    lowest = F.lit(-(1 << 63)).cast("long")
    placed = unique.withColumn("sort_key", F.struct(F.coalesce("doc_id", lowest).alias("a"), F.col("doc_id").isNotNull().alias("b"), F.col("hash").alias("c")))
    # Few such tables exist; the order is made by sorted ranges, each numbered after those before it.
    ranged = materialise(placed.orderBy("sort_key").select("doc_id", "hash", F.monotonically_increasing_id().alias("doc")), "document-order")
    return ranged


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed byte spans and the bytes that stay."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = _in_order(texts)
    if order is None:
        # The id is the order. It has no nulls here, and says so, which spares a second shuffle.
        numbered = texts.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), "text")
    else:
        same = texts["doc_id"].eqNullSafe(order["doc_id"]) & (F.xxhash64(texts["text"]) == order["hash"])
        numbered = materialise(texts.join(order, same).select(F.coalesce("doc", F.lit(0)).alias("doc"), texts["text"]).distinct(), "documents")
    found = numbered.select("doc", "text").mapInArrow(_find_anchors, "anchor long, doc long, spot long")
    # As a table of its own, so that the join below can split a crowded anchor.
    repeated = materialise(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "anchor-counts")
    again = found.join(repeated, "anchor").select("doc", "spot", (F.col("n") > hot).alias("hot"))
    spots = materialise(again, "repeated-anchors")
    parts = max(1, -(-spots.count() * (LENGTH + 40) // part_bytes))
    by_doc = spots.groupBy("doc").agg(F.collect_list("spot").alias("spots"), F.collect_list("hot").alias("hot"))
    cut = numbered.join(by_doc, "doc", "left").filter("spots is not null").select("doc", "text", "spots", "hot")
    stretches = cut.mapInArrow(_cut_stretches, "key long, stretch binary, doc long, start long")
    kept = stretches.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(_keep_earliest, "doc long, first long, last long")
    # No table in between: both joins by document read one shuffle of the texts.
    keep_by_doc = kept.groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    whole = numbered.join(by_doc, "doc", "left").join(keep_by_doc, "doc", "left")
    # A text without a repeated anchor stays as it is, and out of Python.
    touched = F.col("spots").isNotNull()
    cut_down = whole.select("doc", "text", touched.alias("touched"), F.arrow_udf(_apply, _LEFT)(F.when(touched, F.col("text")), "spots", "firsts", "lasts").alias("r"))
    either = lambda made, kept: F.when(F.col("touched"), F.col(f"r.{made}")).otherwise(kept).alias(made)
    done = cut_down.select(
        "doc", either("n_bytes", F.octet_length("text").cast("long")), either("spans", F.array().cast("array<struct<from: bigint, until: bigint>>")),
        either("kept", F.col("text").cast("binary")),
    )
    if order is None:
        return done.withColumnRenamed("doc", "doc_id")
    done = done.join(order.withColumnRenamed("doc", "of_doc"), F.col("doc") == F.col("of_doc")).drop("doc", "of_doc")
    rows = texts.select("doc_id", F.xxhash64("text").alias("hash"))
    back = rows["doc_id"].eqNullSafe(done["doc_id"]) & (rows["hash"] == done["hash"])
    return rows.join(done, back).select(rows["doc_id"], "n_bytes", "spans", "kept")


def _removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["from"])


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", _removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
