"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of 13 consecutive words of an item (the whole item if shorter). For
each window length there is a table of block shifts: the last two words under the window say
how far the window may move without missing a test string. Where the shift is zero, the
bucket of that block gives the test strings that end so, and comparing them word by word
confirms an occurrence.

Cases: a null or empty text has no words, no hits and is not contaminated; a null or wordless
item is never found. Repeated document rows are judged one by one; repeated items are found
together (an id occurs once in the list, a null item id as the text ``null``). An empty table
of documents gives no rows, an empty benchmark gives rows without hits. Other columns are not
read, whatever their names. The benchmark is read in blocks of bounded size, each of which
passes over all documents, so no broadcast grows with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import alnum_words, table

WINDOW = 13
SHARE = 20  # contaminated if 20 * hit words >= all words
BLOCK_WORDS = 2_000_000  # words of windows that one broadcast holds at most
HITS = "struct<n_words: bigint, spans: array<struct<from: bigint, until: bigint>>, items: array<string>>"


class WuManber:
    """Test strings of one length, over words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length = length
        self.block = min(2, length)
        self.free = length - self.block + 1  # the shift of a block that no test string has
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.free), length - end)
            self.bucket.setdefault(words[-self.block :], []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of every occurrence."""
        length, shift, free, pair = self.length, self.shift, self.free, self.block == 2
        end, n = length, len(words)
        while end <= n:
            block = (words[end - 2], words[end - 1]) if pair else (words[end - 1],)
            step = shift.get(block, free)
            if step:
                end += step
                continue
            under = tuple(words[end - length : end])
            for pattern, items in self.bucket[block]:
                if pattern == under:
                    yield end - length, items
            end += 1


def _windows(text: str | None, window: int) -> set[tuple[bytes, ...]]:
    words = tuple(alnum_words(text))
    if not words:
        return set()
    size = min(window, len(words))
    return {words[i : i + size] for i in range(len(words) - size + 1)}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, bound: int) -> Iterator[list[WuManber]]:
    """Search tables over parts of the benchmark, each of at most ``bound`` words (or one item)."""
    held: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    size = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col))
    for item, text in rows.toLocalIterator():
        found = _windows(text, window)
        words = sum(map(len, found))
        if size and size + words > bound:
            yield [WuManber(p, n) for n, p in sorted(held.items())]
            held, size = {}, 0
        for w in found:
            held.setdefault(len(w), {}).setdefault(w, set()).add(item)
        size += words
    yield [WuManber(p, n) for n, p in sorted(held.items())]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search(text: str | None, tables: Iterable[WuManber]) -> tuple[int, list[tuple[int, int]], set[str]]:
    words = alnum_words(text)
    spans, items = [], set()
    for t in tables:
        for start, found in t.find(words):
            spans.append((start, start + t.length))
            items |= found
    return len(words), _merge(spans), items


def _finder(tables) -> Column:
    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            n, spans, items = search(text.as_py(), tables.value)
            rows.append({"n_words": n, "spans": [{"from": a, "until": b} for a, b in spans], "items": sorted(items)})
        kind = pa.struct(
            [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))), ("items", pa.list_(pa.string()))]
        )
        return pa.array(rows, kind)

    return hits


def _join_hits(left: Column, right: Column) -> Column:
    """Hits of two blocks of the benchmark, in one row."""

    @F.arrow_udf(HITS)
    def join(a_rows: pa.Array, b_rows: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(a_rows.to_pylist(), b_rows.to_pylist()):
            spans = _merge([(s["from"], s["until"]) for s in a["spans"] + b["spans"]])
            rows.append({"n_words": a["n_words"], "spans": [{"from": x, "until": y} for x, y in spans], "items": sorted({*a["items"], *b["items"]})})
        return pa.array(rows, a_rows.type)

    return join(left, right)


def hits_of(text: Column, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, bound: int = BLOCK_WORDS) -> Column:
    """Struct column: number of words, covered word spans (merged, half open), items found."""
    spark = benchmark.sparkSession
    out = None
    for tables in _blocks(benchmark, item_col, text_col, window, bound):
        found = _finder(spark.sparkContext.broadcast(tables))(text)
        out = found if out is None else _join_hits(out, found)
    return out


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits["spans"], F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["from"])


def is_contaminated(n_hit: Column, n_words: Column, share: int = SHARE) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, word spans covered by occurrences, items found, verdict."""
    found = docs.select(F.col(id_col).alias("doc_id"), hits_of(F.col(text_col), benchmark).alias("hits"))
    counted = found.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit(F.col("hits")).alias("n_hit"), F.col("hits.spans").alias("spans"), F.col("hits.items").alias("items"))
    return counted.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
