"""The filter holds every n-gram, its scores are probabilities, and what is broadcast changes none."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import lm
from riskweave.llm.common import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    planted = spark.createDataFrame([(9001, None), (9002, ""), (9003, "words nobody wrote"), (9003, "words nobody wrote"), (None, "a null id")], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(planted)


def exact(texts):
    """Counts of unigrams and of bigrams, by n-gram."""
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        tokens = lm.tokens_of(t)
        one.update(lm.gram(tokens).tolist())
        two.update(lm.gram(lm.bigrams_of(tokens)).tolist())
    return one, two


def arrays(counts):
    return np.array(list(counts), dtype=np.uint64), np.array(list(counts.values()))


def test_levels_and_six_bytes():
    counts = np.array([1, 2, 10, 11, 100, 10**6, 10**12])
    levels = lm.level_of(counts)
    assert levels[:3].tolist() == [1, 2, 10] and (np.diff(levels) >= 0).all() and levels[-1] == lm.MAX_LEVEL
    grams = np.sort(np.random.default_rng(0).integers(0, 1 << lm.GRAM_BITS, 5000).astype(np.uint64))
    for bits in (8, 11, 20):
        back = [lm._whole(lm._six(grams[at]), g, bits) for g, at in lm._by_group(grams, bits)]
        assert (np.concatenate(back) == grams).all()


def test_filter_never_lowers_a_level():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << lm.GRAM_BITS, 30_000).astype(np.uint64)
    levels = lm.level_of(rng.integers(1, 50, len(grams)))
    group = grams >> np.uint64(lm.GRAM_BITS - 8)
    made = [(g, *(lambda s, b: (s, 12, b))(*lm.build_bits(grams[group == g], levels[group == g], 12))) for g in range(256)]
    bloom = lm.LogBloom.of(8, made)
    found = bloom.levels(grams)
    assert (found >= levels).all() and (found > levels).mean() < 1.5 / 2**lm.PROBES
    absent = rng.integers(0, 1 << lm.GRAM_BITS, 400_000).astype(np.uint64)
    assert (bloom.levels(absent) > 0).mean() < 2 / 2**12
    part = lm.LogBloom.of(8, made[:100])
    assert (part.holds(grams) == (group < 100)).all() and (part.levels(grams) == np.where(group < 100, found, 0)).all()


def test_filter_grows_with_the_ngrams(docs):
    train = docs.filter(F.col("doc_id") % 5 != 1)
    one, two = exact(r.text for r in train.collect())
    model = lm.learn(train)
    assert model.n_types == len(one) and model.n_tokens == sum(one.values()) and model.all_sent and model.all_frequent
    for n, counts in enumerate((one, two)):
        grams, c = arrays(counts)
        read = model.bloom.levels(grams)
        assert (read >= lm.level_of(c)).all() and (read == lm.level_of(c)).mean() > 0.95  # n-grams seen once are known
        # Levels stand for what they hold in the mean, so the counts read add up to those counted.
        assert model.means[n][read].sum() == pytest.approx(c.sum(), rel=0.02)
    part = lm.learn(train, max_bytes=model.bloom.bits.nbytes // 3, frequent=50)
    assert not part.all_sent and not part.all_frequent and 0 < len(part.bloom.bits) < model.bloom.bits.nbytes
    assert part.groups.count() == model.groups.count()


@pytest.mark.parametrize("bound", [100_000, 0])
def test_broadcast_bound_changes_no_score(docs, monkeypatch, bound):
    monkeypatch.setattr(lm, "CHUNK", 20_000)  # many chunks
    monkeypatch.setattr(lm, "FLUSH", 5_000)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 700)
    train = docs.filter(F.col("doc_id") % 5 != 1)
    order = ["doc_id", "n_tokens", "score"]
    wide = lm.score(docs, lm.learn(train)).toPandas().sort_values(order, ignore_index=True)
    narrow = lm.score(docs, lm.learn(train, max_bytes=bound, frequent=50)).toPandas().sort_values(order, ignore_index=True)
    assert len(wide) == docs.count()
    assert (wide.doc_id.fillna(-1) == narrow.doc_id.fillna(-1)).all() and (wide[["n_tokens", "n_known"]] == narrow[["n_tokens", "n_known"]]).all().all()
    assert np.allclose(wide.score, narrow.score, rtol=1e-12) and np.allclose(wide.base_score, narrow.base_score, rtol=1e-9)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_conditional_probabilities_add_up_to_one(spark, folder):
    """Over the whole vocabulary and one unknown word, for contexts of all frequencies, at two sizes."""
    train = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").filter(fold("doc_id", 5) != 1)
    model = lm.learn(train)
    words = np.unique(np.concatenate([lm.tokens_of(r.text) for r in train.collect()]))
    counts = exact(r.text for r in train.collect())[0]
    ranked = sorted(words.tolist(), key=lambda w: -counts[int(lm.gram(np.array([w], np.uint64))[0])])
    low = model.unigram(model.bloom.levels(lm.gram(words)))
    unknown = 0.5 / (model.n_tokens + 0.5 * (model.n_types + 1))
    assert low.sum() + unknown == pytest.approx(1, abs=0.02)
    for h in [*ranked[:6], *ranked[50:2000:400], *ranked[-3:]]:
        pairs = lm.gram(np.concatenate([lm.ngram_hashes(np.array([h, w], np.uint64), 2) for w in words.tolist()]))
        context = np.full(len(words), model.bloom.levels(lm.gram(np.array([h], np.uint64)))[0])
        total = model.bigram(model.bloom.levels(pairs), context, low).sum()
        assert total == pytest.approx(1, abs=0.05)


def test_scores_are_near_those_of_exact_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    data = {r.doc_id: lm.tokens_of(r.text) for r in docs.collect()}
    one, two = collections.Counter(), collections.Counter()
    for i, t in data.items():
        if not held(i):
            one.update(t.tolist())
            two.update(lm.bigrams_of(t).tolist())
    n, v = sum(one.values()), len(one)
    got = {r.doc_id: r for r in lm.op6_lm_score(spark, "/root/testdata/sf0.01").collect()}
    off = []
    for i, t in data.items():
        pairs, before = lm.bigrams_of(t).tolist(), [int(lm.END), *t[:-1].tolist()]
        want = sum(math.log10((two[b] + lm.MU * (one[w] + 0.5) / (n + 0.5 * (v + 1))) / (one[h] + lm.MU)) for w, b, h in zip(t.tolist(), pairs, before))
        off.append((got[i].score - want) / len(t))
    # The stated distance: 0.01 of a digit per token in the mean, 0.1 for any document.
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.1


def test_no_training_rows(docs):
    for bound in (0, lm.MAX_BYTES):
        rows = lm.score(docs, lm.learn(docs.limit(0), max_bytes=bound)).toPandas()
        assert len(rows) == docs.count() and np.isfinite(rows.score).all() and (rows.n_known == 0).all()


def test_one_shuffle_of_ngrams_gives_the_scores_of_two(docs):
    """Counting and asking at once, with repeated and null rows; folds of all, some, none and null."""
    order = ["doc_id", "n_tokens", "score"]
    held = fold("doc_id", 5) == 1
    for learns in (~held, F.lit(True), F.lit(False), F.when(~held, True)):
        apart = lm.score(docs, lm.learn(docs.filter(learns))).toPandas().sort_values(order, ignore_index=True)
        at_once = lm.learn_and_score(docs, learns).toPandas().sort_values(order, ignore_index=True)
        assert len(apart) == docs.count() and list(apart.columns) == list(at_once.columns)
        assert (apart.doc_id.fillna(-1) == at_once.doc_id.fillna(-1)).all()
        assert (apart[["n_tokens", "n_known", "train_tokens"]] == at_once[["n_tokens", "n_known", "train_tokens"]]).all().all()
        assert np.allclose(apart.score, at_once.score, rtol=1e-12) and np.allclose(apart.base_score, at_once.base_score, rtol=1e-12)
    assert lm.learn_and_score(docs.limit(0), ~held).count() == 0


def test_blocks_posed_hold_counts_of_any_size():
    """Counts of 255 and more travel apart from the others, in each group's block and in the answers."""
    import pyarrow as pa

    texts = ["the " * 300 + "end", "the cat " * 260, "a cat sat"]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([0] * 3, pa.int32()), "text": texts, "learns": [True, True, False]})
    posed = [b for b in lm._pose(8)(iter([batch]))]
    by_group = pa.Table.from_batches(posed).sort_by("group").to_batches()
    answers = pa.Table.from_batches(list(lm._build_and_answer(8, lm.MU)(iter(by_group)))).to_pylist()
    one, _ = exact(texts[:2])
    asked = {g: a for g, a in zip(sorted({t for t in lm.gram(np.concatenate([lm.tokens_of(t) for t in texts])).tolist()}), lm._read_counts(*(b"".join(r[c] for r in answers if r["chunk"] is not None) for c in ("counts", "large"))).tolist())}
    assert asked == {g: one.get(g, 0) for g in asked} and max(asked.values()) == 560 and min(asked.values()) == 0
    # A block of bigrams is posed once for every chunk and group, counted and asked alike: 6 bytes each.
    two = {g for t in texts for g in lm.gram(lm.bigrams_of(lm.tokens_of(t))).tolist()}
    assert sum(len(b) for p in posed for b in p.column("others").to_pylist()) == 6 * len(two)


def test_chunks_change_no_score(monkeypatch):
    """Chunks of one text, of some and of all, through the steps as Spark would run them; few tokens at a time."""
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(rng.zipf(1.3), 400)}" for _ in range(rng.integers(0, 200))) for _ in range(60)] + [None, "", "nobody wrote this"]
    learns = [i % 5 != 1 for i in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({"part": pa.array([3] * len(texts), pa.int32()), "text": texts, "learns": learns, "doc_id": list(range(len(texts)))})
    one, two = exact(t for t, known in zip(texts, learns) if known)
    scores, many = [], []
    for chunk, at_once in ((1, 1), (2_000, 150), (lm.CHUNK, lm.BATCH_TOKENS)):
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "BATCH_TOKENS", at_once)
        batches = [batch.slice(0, 7), batch.slice(7, 40), batch.slice(47)]
        posed = pa.Table.from_batches(list(lm._pose(8)(b.select(["part", "text", "learns"]) for b in batches))).sort_by("group")
        answers = pa.Table.from_batches(list(lm._build_and_answer(8, lm.MU)(iter(posed.to_batches()))))
        levels = collections.defaultdict(lambda: np.zeros(2, dtype=int))
        for h in answers.column("histogram").to_pylist():
            for r in h or []:
                levels[r["n"], r["level"]] += (r["grams"], r["total"])
        means = tuple(lm.mean_counts({at: tuple(v) for (k, at), v in levels.items() if k == n}) for n in (1, 2))
        n_tokens, n_types = sum(one.values()), len(one)
        assert sum(v[1] for (k, _), v in levels.items() if k == 2) == sum(two.values())
        nobody = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        model = lm.Model(None, 8, n_tokens, n_types, lm.LogBloom.of(8, []), False, means, nobody, False, -1)
        rater = lm._Rate(SimpleNamespace(value=model), lm.MU, ["doc_id"])
        dealt = pa.Table.from_batches(list(lm._deal(b.select(["part", "text", "doc_id"]) for b in batches)))
        found = []
        for c in sorted(set(dealt.column("chunk").to_pylist())):
            pick = lambda t: t.filter(pa.compute.equal(t.column("chunk"), c))
            found += rater.chunk(pick(dealt), pick(answers)).to_pylist()
        assert [r["doc_id"] for r in found] == list(range(len(texts)))
        many.append(len(set(dealt.column("chunk").to_pylist())))
        for r, t in zip(found, texts):
            tokens = lm.gram(lm.tokens_of(t)).tolist()
            assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(g in one for g in tokens)
            base = sum(math.log10((one[g] + 0.5) / (n_tokens + 0.5 * (n_types + 1))) for g in tokens)
            assert r["base_score"] == pytest.approx(base, rel=1e-12)
        scores.append([r["score"] for r in found])
    assert many[0] > 50 > many[1] > many[2] == 1
    assert np.allclose(scores[0], scores[1], rtol=1e-12) and np.allclose(scores[0], scores[2], rtol=1e-12)


def test_query_shuffles_each_ngram_once(spark, monkeypatch):
    """The query poses its n-grams in one shuffle: neither learns apart nor asks again."""
    for name in ("learn", "_answers"):
        monkeypatch.setattr(lm, name, lambda *_, **__: pytest.fail("n-grams would be shuffled twice"))
    assert lm.op6_lm_score(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
