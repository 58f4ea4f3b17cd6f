"""Jaccard join, repeats, language model, WARC, neighbours and components against plain Python."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import jaccard, lm, neighbours, repeats, warc
from riskweave.llm.common import ship
from riskweave.llm.components import components
from riskweave.session import fresh_path

SF = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def roots_of(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7)] + [(500, 600 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots_of(pairs)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for k in want if list(want.values()).count(want[k]) > 1)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard join ----------------------------------------------------------------------------------


def plain_classes(rows, percent=90):
    """rows: (id, text), ids unique."""
    sets = {}
    for k, t in rows:
        w = words(t)
        sets[k] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    keys = list(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots_of(links)
    return {k: (len(sets[k]), root.get(k, k)) for k in keys}


def near_copies(seed, groups=6, copies=12, size=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(size + 7 * g)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("capacity", [4_000_000, 400])
def test_jaccard_against_all_pairs(spark, capacity):
    rows = list(enumerate(near_copies(1) + ["a b", "A  B", "a", "", None, "b a", "the the the the"]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame, capacity=capacity).collect()}
    assert got == plain_classes(rows)


def test_regions_split_and_join(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    texts = near_copies(5, groups=9, copies=15, size=40)
    sets = [jaccard.shingles(t) for t in texts]
    want = plain_classes(list(enumerate(texts)))
    assert jaccard.classes(sets).tolist() == [want[i][1] for i in range(len(texts))]


def test_jaccard_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op3_jaccard_join(spark, SF).collect()}
    assert got == plain_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_jaccard_cases(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", "x"), (None, "p q r", "x"), (2, None, "x"), (2, "", "x"), (1, "A b C d", "x"), (9, " \t", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sid string").withColumn("root", F.lit(1)).withColumn("key", F.lit(2))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame).collect())
    assert got == {(5, 2, 1): 2, (None, 2, 1): 1, (None, 1, None): 1, (2, 0, 2): 2, (1, 2, 1): 1, (9, 0, 9): 1}
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "p q r"), (1, "A b C d"), (2, ""), (9, " \t")]
    assert jaccard.jaccard_classes(frame.limit(0)).count() == 0


# repeats ---------------------------------------------------------------------------------------


def plain_repeats(docs, length=100):
    """docs: bytes in document order; a mask of removed bytes for each."""
    seen, out = set(), []
    for d in docs:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        out.append(gone)
    return out


def made_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(70):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.5:
            a = rng.randint(0, 100)
            t += passage[a : a + rng.randint(80, 200)] + " ".join(word() for _ in range(30))
        if texts and rng.random() < 0.2:
            t = rng.choice(texts)[: rng.randint(50, 400)] + t
        if rng.random() < 0.1:
            t += "a" * rng.randint(50, 400)
        if rng.random() < 0.05:
            t += "\0" * 300 + "ab" * 120
        texts.append(t)
    return texts


@pytest.mark.parametrize("hot,part_bytes", [(10_000, 3 << 20), (3, 4_000)])
def test_repeats_against_plain_search(spark, monkeypatch, hot, part_bytes):
    texts = made_texts(hot)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain_repeats([t.encode() for t in texts])
    for r in repeats.find_repeats(frame, hot=hot, part_bytes=part_bytes).collect():
        raw, gone = texts[r.doc_id].encode(), want[r.doc_id]
        got = np.zeros(len(raw), bool)
        for s in r.spans:
            got[s["from"] : s["until"]] = True
        assert (got == gone).all() and bytes(r.kept) == np.frombuffer(raw, np.uint8)[~gone].tobytes() and r.n_bytes == len(raw)


def test_long_texts_are_worked_through_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    data = np.frombuffer("".join(made_texts(9)).encode(), np.uint8)
    found = repeats.anchors(data)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 21)
    whole = repeats.anchors(data)
    spread = lambda x: [(p, s) for _, p, f, t in zip(*x) for s in range(f, t + 1)]
    assert spread(found) == spread(whole) and [s for _, s in spread(whole)] == list(range(len(data) - 99))


@pytest.mark.parametrize("block", [1, 7, 300, 1 << 15])
def test_anchors_do_not_depend_on_blocks(monkeypatch, block):
    """Hashes are worked on in blocks that fit a cache; an anchor that goes on in the next block stays one."""
    data = np.frombuffer(("".join(made_texts(5)) + "a" * 500).encode()[-3000:], np.uint8)
    monkeypatch.setattr(repeats, "BLOCK", block)
    h, place, first, last = repeats.anchors(data)
    every = repeats.piece_hashes(data)
    rank = [(int(x) >> repeats.PLACE_BITS, i) for i, x in enumerate(every)]
    want = [min(rank[s : s + 81])[1] for s in range(len(data) - 99)]
    assert [p for p, f, t in zip(place, first, last) for _ in range(f, t + 1)] == want
    assert (np.diff(place) != 0).all() and (h == every[place]).all()


def test_keys_hash_their_own_pieces_alone(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 4000).astype(np.uint8)
    place = np.array([0, 1, 77, 1900, 3980])
    want = repeats.piece_hashes(data)[place].view(np.int64)
    monkeypatch.setattr(repeats, "piece_hashes", lambda *_: pytest.fail("hashes of every place are not needed"))
    assert (repeats._keys_at(data, place) == want).all() and len(repeats._keys_at(data, place[:0])) == 0


@pytest.mark.parametrize("seed", range(5))
def test_removed_spans_from_bounds(monkeypatch, seed):
    """By the bounds of the ranges alone, however many starts they hold; against a mask of all starts."""
    rng = random.Random(seed)
    firsts = sorted(rng.sample(range(2500), 25))
    ranges = [(f, min(f + rng.randint(0, 80), n - 1)) for f, n in zip(firsts, [*firsts[1:], 2600])]
    kept = [(a, z) for f, t in ranges if rng.random() < 0.6 for a in [rng.randint(f, t)] for z in [rng.randint(a, t)]]
    gone = np.zeros(2800, bool)
    starts = {s for f, t in ranges for s in range(f, t + 1)} - {s for a, z in kept for s in range(a, z + 1)}
    for s in starts:
        gone[s : s + 100] = True
    first, last = np.array(ranges).T
    spots = np.tile(repeats._pack(first, first, last), 2)  # equal rows give a document's spots twice
    monkeypatch.setattr(np, "setdiff1d", lambda *_: pytest.fail("starts are not listed"))
    got = repeats.removed_spans(spots, *np.array(kept, dtype=np.int64).reshape(-1, 2).T)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    assert got == list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    everything = repeats.removed_spans(spots, first, last)
    assert everything == []


def test_run_index_finds_blocks():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(90))
    stretches = [base[i : i + 40] + bytes([rng.choice(b"abc")]) * (i % 3) for i in range(0, 50, 3)]
    first = {}
    got = repeats.earliest(stretches, 24)
    for j, s in enumerate(stretches):
        want = []
        for a in range(len(s) - 23):
            if s[a : a + 24] not in first:
                first[s[a : a + 24]] = True
                want.append(a)
        assert got[j].tolist() == want


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics_against_plain_search(seed):
    rng = random.Random(seed)
    length = rng.choice([6, 8, 9, 13, 20, 100])
    alphabet = bytes(rng.sample(range(256), rng.choice([1, 2, 3, 30, 200]))) + b"\0" * rng.randint(0, 1)
    base = bytes(rng.choice(alphabet) for _ in range(300))
    stretches = []
    for _ in range(rng.randint(2, 24)):
        a = rng.randint(0, 190)
        s = bytearray(base[a : a + length + rng.randint(0, 80)])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice(alphabet)
        stretches.append(bytes(s))
    held, others = stretches[: len(stretches) // 2], stretches[len(stretches) // 2 :]
    index = repeats.RunIndex(held, length)
    for which, start, matched in index.statistics(others, length):
        for j, a, m in zip(which, start, matched):
            s = others[j][a : a + length]
            assert m == next(n for n in range(length, -1, -1) if any(s[:n] in h for h in held))  # of stretches that may still reach the length
    strings = {h[i : i + length] for h in held for i in range(len(h) - length + 1)}
    want = [[i for i in range(len(s) - length + 1) if s[i : i + length] not in strings] for s in others]
    assert [f.tolist() for f in repeats.unmatched(index, others, length)] == want


@pytest.mark.parametrize("first,growth", [(1, 2), (4, 64)])
def test_many_variants_of_one_passage(first, growth, monkeypatch):
    monkeypatch.setattr(repeats, "FIRST", first)
    monkeypatch.setattr(repeats, "GROWTH", growth)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = []
    for _ in range(150):  # two or three variants at each of some places: several rounds of what is left
        t = list(passage)
        for at in (30, 150, 155, 260, 390):
            t[at] = rng.choice("XYZ")
        texts.append("".join(t))
    # Stretches around one place, as a part gets them, in any order.
    rows = [(at, t[at : at + 180].encode(), doc, at) for at in (0, 200) for doc, t in enumerate(texts)]
    rng.shuffle(rows)
    part = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("key", "stretch", "doc", "start"))})
    got = sorted((d, s) for d, a, z in zip(*repeats._keep_earliest(part).to_pydict().values()) for s in range(a, z + 1))
    seen, want = set(), []
    for at, stretch, doc, start in sorted(rows, key=lambda r: r[2:]):
        for i in range(len(stretch) - 99):
            if (at, stretch[i : i + 100]) not in seen:
                seen.add((at, stretch[i : i + 100]))
                want.append((doc, start + i))
    assert got == sorted(want)


def test_repeat_cases(spark):
    rows = [(None, "x" * 250), (1, "x" * 120), (1, "y" * 300), (1, "y" * 300), (2, None), (3, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("c")).withColumn("spans", F.lit(1))
    got = repeats.find_repeats(frame).collect()
    shown = sorted((r.doc_id or 0, r.n_bytes, [(s["from"], s["until"]) for s in r.spans]) for r in got)
    assert shown == [(0, 0, []), (0, 250, [(1, 250)]), (1, 120, [(0, 120)]), (1, 300, [(1, 300)]), (1, 300, [(1, 300)]), (2, 0, []), (3, 0, [])]
    assert repeats.find_repeats(frame.limit(0)).count() == 0


def test_repeat_query(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want = plain_repeats([t.encode() for _, t in docs])
    got = {r.doc_id: r for r in repeats.op5_repeats(spark, SF).collect()}
    for (k, t), gone in zip(docs, want):
        kept = np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(gone), gone.sum(), spans, hashlib.sha256(kept).hexdigest())


# language model --------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent", [1 << 19, 20])
def test_unigram_scores_are_exact(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "zz zz Unseen")], "doc_id long, text string")
    rows = docs.unionByName(extra).withColumn("row", F.lit("r")).withColumn("c", F.lit(0))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    from riskweave.llm.common import fold

    model = lm.learn(rows.filter(fold("doc_id", 5) != 1), frequent=frequent)
    got = lm.score(rows, model).collect()
    data = rows.select("doc_id", "text").collect()
    counts = collections.Counter(t for r in data if not held(r.doc_id) for t in [*words(r.text), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in data:
        t = [*words(r.text), None]
        want[(r.doc_id, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5))] += 1
    assert want == collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert all(r.score < 0 for r in got)


def test_model_beats_unigrams_on_held_out_text(spark):
    got = lm.op6_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and got.doc_id.is_unique and len(got) == 1000


def test_lm_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.learn(empty)
    assert lm.score(empty, model).count() == 0
    one = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert one.n_known == 0 and math.isfinite(one.base_score) and math.isfinite(one.score)


# WARC ------------------------------------------------------------------------------------------


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op7_warc(spark, SF).collect()}
    largest = {}
    for r in pages:
        p = (r.html or "").encode()
        largest[p] = max(largest.get(p, r.page_id), r.page_id)
    for r in pages:
        p, x = (r.html or "").encode(), got[r.page_id]
        first = largest[p] == r.page_id
        assert (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) == (len(p), digest(p), "response" if first else "revisit", None if first else largest[p])


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(spark, compress, tmp_path):
    inner = warc.record_bytes(77, None, b"inside", None, False, "d").decode()
    rows = [(i, f"http://x/{i}\n", f"page {i} é " * (1 + i % 50)) for i in range(60)] + [(100, None, None), (101, "u", ""), (102, "u", inner * 3), (None, "u", "null id"), (5, "u", "page 5 é " * 6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("x")).coalesce(1)
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(frame, folder, compress=compress)
    whole = warc.settle(warc.read_archives(manifest, range_bytes=512)).collect()
    assert collections.Counter(r.page_id for r in whole) == collections.Counter(r[0] for r in rows)
    assert warc.gaps(manifest, warc.settle(warc.read_archives(manifest, range_bytes=700))).count() == 0
    # Break three records: two next to each other, and the last one.
    (path,) = [r.path for r in manifest.collect()]
    spans = sorted((r.offset, r.until, r.page_id) for r in whole)
    data = bytearray(open(path, "rb").read())
    lost = [spans[7], spans[8], spans[-1]]
    for a, z, _ in lost:
        data[(a + z) // 2] ^= 0xFF
    open(path, "wb").write(data)
    for size in (512, 1 << 24):
        records = warc.settle(warc.read_archives(manifest, range_bytes=size))
        assert sorted((r.offset, r.until) for r in records.collect()) == [s[:2] for s in spans if s not in lost]
        holes = sorted(tuple(r)[1:] for r in warc.gaps(manifest, records).collect())
        assert holes == [(lost[0][0], lost[1][1]), lost[2][:2]]


def test_warc_cases(spark):
    frame = spark.createDataFrame([(3, "a"), (3, "a"), (1, "a"), (None, "a"), (None, "z"), (4, None), (2, "")], "page_id long, html string")
    read = lambda least: sorted(
        ((r.page_id or 0), r.record_type, r.refers_to or 0) for r in warc.read_archives(warc.write_archives(frame, fresh_path(spark, "w"), url_col=None, least=least)).collect()
    )
    assert read(0) == [(0, "response", 0), (0, "revisit", 3), (1, "revisit", 3), (2, "revisit", 4), (3, "response", 0), (3, "response", 0), (4, "response", 0)]
    assert [x[1] for x in read(10)] == ["response"] * 7
    none = warc.write_archives(frame.limit(0), fresh_path(spark, "w"), url_col=None)
    assert none.count() == 0 and warc.read_archives(none).count() == 0


# neighbours ------------------------------------------------------------------------------------


def plain_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        d = sorted((math.dist(v, x), i) for i, x in rows if i != q and i is not None)
        out[q] = d[:k]
    return out


def test_probe_sets_come_in_order():
    costs = [0.04, 0.64, 0.25, 0.25, 0.01, 0.81]
    sets = neighbours.probe_sets(costs, 12)
    totals = [sum(costs[i] for i in s) for s in sets]
    assert totals == sorted(totals) and len(set(map(frozenset, sets))) == len(sets) and sets[0] == (4,)
    assert all(len({i >> 1 for i in s}) == len(s) for s in sets)


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    got = neighbours.op10_neighbours(spark, sf).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g.score.is_monotonic_increasing
        vec = dict(rows)
        assert np.allclose(g.score, [math.dist(vec[q], vec[i]) for i in g.vec_id], rtol=1e-12)
        hits += len({i for _, i in want[q]} & set(g.vec_id))
    assert hits / (10 * len(want)) >= 0.9


def test_neighbour_cases(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(0, 40)] + [(i, rng.normal(size=3).tolist()) for i in range(40, 60)]
    bad = [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (700, [1.0, 2.0]), (None, same)]
    frame = spark.createDataFrame(rows + bad + [rows[0]], "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(1))
    got = neighbours.search(frame, F.col("vec_id") % 20 == 0, k=10)
    want = plain_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    found = collections.defaultdict(list)
    for r in got.collect():
        found[r.query_id].append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in found.items()}.keys() == want.keys()
    for q in (0, 20):
        assert [i for _, i in sorted(found[q])] == [i for _, i in want[q]]
    few = neighbours.search(frame.filter("vec_id in (0, 41, 42)"), F.col("vec_id") % 20 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [41, 42]
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(frame.filter("vec_id = 200"), F.col("vec_id") % 20 == 0).count() == 0
