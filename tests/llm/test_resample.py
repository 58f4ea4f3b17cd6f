"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from riskweave.llm import resample
from riskweave.session import materialise

SCHEMA = "doc_id long, text string, weight string, k1 int"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain(rows, target, n=1, percent=10, least=20):
    """rows: (id, text); returns sorted (id, features, weight, score, rank)."""

    def buckets(text):
        w = words(text)
        return [zlib.crc32(b" ".join(w[i : i + m])) % 10000 for m in range(1, n + 1) for i in range(len(w) - m + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    made = []
    for doc_id, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append((doc_id, len(buckets(text)), weight, score, len(words(text))))
    may = sorted((m for m in made if m[4] >= least), key=lambda m: (-m[3], -(2**63) if m[0] is None else m[0], m[1]))
    drawn = len(may) * percent // 100
    others = [m for m in made if m[4] < least] + may[drawn:]
    out = [(*m[:4], i) for i, m in enumerate(may[:drawn], 1)] + [(*m[:4], None) for m in others]
    return sorted(out, key=str)


def run(spark, rows, target, **how):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    n = how.pop("n", 1)
    scored = materialise(resample.score_documents(docs, goal, n=n), "scores")
    least, percent = how.get("least", 20), how.get("percent", 10)
    got = resample.draw(scored, percent, least).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str)


def corpus(n=150):
    # Numbers decide the words, so rows differ in length and in what they share with the target.
    return [(i * 7 % 1000, " ".join(f"w{(i * k) % 37}" for k in range(1, 15 + i % 30)) + (" Élan Target" if i % 5 == 0 else "")) for i in range(n)]


def edge_rows():
    same = " ".join(f"same{k}" for k in range(25))
    return [(None, None), (None, ""), (1, "few words"), *[(77, same)] * 60, (77, same + " x"), (None, same), (None, same), (-5, same), (5, "long " * 40_000)]


@pytest.mark.parametrize("n", [1, 2])
def test_against_plain_python(spark, n):
    rows, target = corpus() + edge_rows(), ["target words élan w3 w4", None, "TARGET target"]
    assert run(spark, rows, target, n=n) == plain(rows, target, n)


@pytest.mark.parametrize("percent", [0, 1, 37, 50, 99, 100])
def test_cut_inside_a_crowd_of_equal_rows(spark, percent):
    rows, target = corpus(40) + edge_rows(), ["same1 same2 same3"]
    got = run(spark, rows, target, percent=percent)
    assert got == plain(rows, target, percent=percent)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_ties_in_score_go_to_the_smaller_id(spark):
    scored = [(i, 30, 30 + i % 2, 0, 5 - i // 40) for i in range(100)]  # 40 rows to a score
    frame = spark.createDataFrame(scored, "doc_id long, n_words long, n_features long, weight long, score long").repartition(7)
    got = {r["rank"]: r.doc_id for r in resample.draw(materialise(frame, "scores"), 53).collect() if r["rank"]}
    assert got == {i + 1: i for i in range(53)}


def test_empty_tables(spark):
    assert run(spark, [], ["goal"]) == []
    assert run(spark, corpus(30), []) == plain(corpus(30), [])
    assert run(spark, [(1, None), (2, "")], [None]) == plain([(1, None), (2, "")], [None])


def test_bound_is_exact_for_any_interval(spark):
    values = [-(1 << 62), -3, -3, 0, 0, 0, 9, 1 << 61, (1 << 62) - 1]
    frame = materialise(spark.createDataFrame([(v,) for v in values], "k long"), "values")
    for need in range(1, len(values) + 1):
        bound, under = resample.smallest_bound(frame, "k", need)
        assert bound == values[need - 1] and under == sum(v < bound for v in values)
