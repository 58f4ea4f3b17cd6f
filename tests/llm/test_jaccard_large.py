"""Blocks over capacity: sketches against all pairs, what is copied, and what a task holds."""

import random
import tracemalloc

import numpy as np
import pytest
from test_table_operators import near_copies, plain_classes

from riskweave.llm import jaccard


@pytest.mark.parametrize("percent", [90, 80])
def test_sketches_tie_all_linked_sets(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (3, 40, 64, 65, 130, 700):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for part in (0.0, 0.03, 0.05, 0.1, 0.2, 0.5):
            fresh = rng.integers(0, 2**64, size, dtype=np.uint64)
            sets += [np.unique(np.where(rng.random(size) < part, fresh, base)), np.unique(base[rng.random(size) >= part])]
    sets = [s for s in sets if len(s)]
    root = jaccard.near_classes(np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets], percent)
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))]
    assert linked and all(root[i] == root[j] for i, j in linked)
    assert (root[root] == root).all() and len(set(root.tolist())) > 6


@pytest.mark.parametrize("capacity", [60, 1000])
def test_cells_of_any_capacity(spark, capacity):
    rows = list(enumerate(near_copies(8, groups=5, copies=10)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame, capacity=capacity).collect()}
    assert got == plain_classes(rows)


def test_a_large_block_is_not_copied_by_shingle(spark, monkeypatch):
    """A chain of families that share passages of their prefixes, but no links: one block over capacity."""
    rng = random.Random(4)
    passages = [[f"p{k}x{i}" for i in range(14)] for k in range(31)]
    rows = []
    for k in range(30):
        own = [f"k{k}x{i}" for i in range(120)]
        for _ in range(4):
            text = [*passages[k], *own, *passages[k + 1]]
            text[rng.randrange(20, 120)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    joined = []
    original = jaccard._join_cells

    def counting(cells, *rest):
        joined.append(jaccard._total(cells))
        return original(cells, *rest)

    monkeypatch.setattr(jaccard, "_join_cells", counting)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame, capacity=1000).collect()}
    want = plain_classes(rows)
    assert got == want
    assert sum(joined) <= 1.5 * sum(n for n, _ in want.values())


def test_memory_of_a_block():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(4000) < 0.01, rng.integers(0, 2**64, 4000, dtype=np.uint64), base)) for _ in range(400)]
    n = sum(map(len, sets))
    tracemalloc.start()
    found = jaccard.classes(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == 0).all()
    assert peak < 36 * n
