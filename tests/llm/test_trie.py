"""The conversation trie against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, p1 string"


def plain(rows):
    """rows: (conv, turn, role, text), turns of one conversation distinct or wholly equal; sorted node rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        bytes_ = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(members[key]) - 1) * bytes_ + sum(saved[k] for k in kids[key])
    out = []
    for key, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if made[c] == key)
        parent = min(members[key[:-1]]) if key else None
        out.append((min(cs), len(key), parent, len(cs), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    taken = lambda c: F.crc32(c.cast("string").cast("binary")) % 9
    got = trie.trie(frame, lambda c: c - c % 5, taken, 8, **how)
    assert got.columns[:3] == ["conv_id", "depth", "parent_conv_id"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def talk(n=60, words=3):
    return [(c, t, "user" if t % 2 == 0 else "bot", f"é{(c * 31 + t * t) % words}") for c in range(n) for t in range(1 + (c * 7) % 12)]


@pytest.mark.parametrize("block", [1, 2, 3, 16])
def test_against_plain_python(spark, block):
    assert run(spark, talk(), block=block) == plain(talk())


def test_edges(spark):
    rows = talk(25) + [(c, t, "u", "same") for c in range(100, 160) for t in range(11)]  # a crowd of copies
    rows += [(None, 1, "u", "x"), (201, None, None, None), (201, 3, "", ""), (202, 1, "u", None), (203, 1, "u", "a"), (203, 1, "u", "a")]
    rows += [(-3, t, "u", f"n{t}") for t in range(4)] + [(-5, t, "u", f"m{t}") for t in range(10)] + [(204, 0, "a", "b"), (206, 0, "ab", "")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, block=2) == plain(rows)


@pytest.mark.parametrize("block", [4, 16])
def test_one_endless_conversation(spark, monkeypatch, block):
    """Its private part needs no round, it spans ranges, and a copy of its opening shares only that."""
    rounds = []
    keep = trie.materialise
    monkeypatch.setattr(trie, "materialise", lambda df, label: rounds.append(label) or keep(df, label))
    rows = talk(20) + [(1000, t, "u", f"t{t % 50}" + "x" * (t % 7)) for t in range(700)] + [(1500, t, "u", f"t{t % 50}" + "x" * (t % 7)) for t in range(30)]
    rows += [(2001, 1, "u", "long " * 50_000)]
    assert run(spark, rows, block=block) == plain(rows)
    assert rounds.count("trie-level") <= 30 + block


def test_all_alike_and_empty(spark):
    assert run(spark, []) == []
    rows = [(c, t, "u", "hi") for c in range(40) for t in range(3)]
    assert run(spark, rows) == plain(rows)
    only = [(7, 1, "u", "x")]  # fewer turns than it borrows from a base that is not there
    assert run(spark, only) == plain(only)


def test_small_parents_and_crowded_ones_agree(spark, monkeypatch):
    monkeypatch.setattr(trie, "MANY_CHILDREN", 3)
    assert run(spark, talk(80, 9)) == plain(talk(80, 9))
