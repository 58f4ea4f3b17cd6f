"""Quality classifier: a second-order factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)),
which takes time linear in the features of a text instead of in their pairs.

Features: every distinct word of the whole text (hashed, scaled so that a text's words weigh
as much as one structure feature each), structure statistics cut at fixed edges, and the
stored text length as metadata, likewise cut. Labels, language, source and id are no features.

The model is fitted on at most ``MAX_ROWS`` labelled rows, chosen by a hash of the id; it is
a few hundred kB and scoring is one pass over the documents without a shuffle. A row that is learned from comes to the
driver as two bytes a feature.

Cases: a null or empty text is scored by its structure features alone. A null stored length
has a feature of its own. Repeated rows get equal scores. Rows without a usable label (null id, null or other
than 0 and 1) are not learned from, a document with several labels is learned with each, and of several rows of one id and
label the one whose features hash lowest is learned.
With no labelled row the model is empty and every score 0.5. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweave.llm.common import fold, table

MAX_ROWS = 20_000  # labelled rows that the model is fitted on at most
BUCKETS = 1 << 15  # hashed words
FACTORS = 8
KEEP_AT = 0.7

_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")
_SIGN = re.compile(rb"[!-/:-@\[-`{-~]")
_SIGN_RUN = re.compile(rb"[!-/:-@\[-`{-~]{2,}")
_UPPER_WORD = re.compile(rb"(?<![^\s])[A-Z]{2,}")
_EDGES = np.array([0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.08, 0.12, 0.2, 0.35, 0.5, 0.7, 0.9])
_SIZES = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 16384, 65536])
_N_SHARES = 10
_N_SLOTS = _N_SHARES + 3
_SLOTS = 16
STRUCTURE = _N_SLOTS * _SLOTS
WIDTH = BUCKETS + STRUCTURE

_WORDS: dict[bytes, int] = {}


def _bucket_ids(words: set[bytes]) -> list[int]:
    known = _WORDS
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = crc32(w) % BUCKETS
    return [known[w] for w in words]


def features(text: str | None, stored: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the features that are not zero, whole text."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    distinct = set(raw.lower().split())
    lines = raw.split(b"\n")
    signs = len(_SIGN.findall(raw))
    shares = (
        len(_UPPER.findall(raw)) / size,
        len(_DIGIT.findall(raw)) / size,
        signs / size,
        len(_SIGN_RUN.findall(raw)) / n,
        len(_UPPER_WORD.findall(raw)) / n,
        sum(map(raw.count, (b"|", b"\t"))) / n,
        (raw.count(b".") + raw.count(b"?")) / n,
        1 - len(distinct) / n if words else 0.0,
        1 - len(set(lines)) / len(lines),
        min(1.0, (size - len(words)) / n / 20),
    )
    slots = [k * _SLOTS + int(np.searchsorted(_EDGES, s, "right")) for k, s in enumerate(shares)]
    slots.append(_N_SHARES * _SLOTS + int(np.searchsorted(_SIZES, len(words), "right")) if words else _N_SHARES * _SLOTS)
    slots.append((_N_SHARES + 1) * _SLOTS + int(np.searchsorted(_SIZES, len(lines), "right")))
    slots.append((_N_SHARES + 2) * _SLOTS + (_SLOTS - 1 if stored is None else min(_SLOTS - 2, int(np.searchsorted(_SIZES, stored, "right")))))
    ids = np.concatenate([np.array(_bucket_ids(distinct), dtype=np.int64), BUCKETS + np.array(slots, dtype=np.int64)])
    values = np.concatenate([np.full(len(distinct), 1 / np.sqrt(max(1, len(distinct)))), np.full(len(slots), 1.0)])
    return ids, values


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def empty(width: int = WIDTH, factors: int = FACTORS) -> FactorisationMachine:
        return FactorisationMachine(0.0, np.zeros(width), np.zeros((width, factors)))

    def margin(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of v x) of texts whose features begin at ``starts``."""
        vx = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = (sums**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weights[ids] * values, starts) + pairs, sums

    def score(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, values, starts)[0], -30, 30)))


class FlatRows(Sequence):
    """The features of many texts in one array: (positions, values) of text k, its words before its structure."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, order: np.ndarray) -> None:
        self.ids, self.starts, self.order = ids, starts, order

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.order[k]
        ids = self.ids[self.starts[at] : self.starts[at + 1]].astype(np.int64)
        words = len(ids) - _N_SLOTS
        return ids, np.append(np.full(words, 1 / np.sqrt(max(1, words))), np.ones(_N_SLOTS))


def fit(
    rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int = WIDTH, factors: int = FACTORS,
    epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 2e-4, seed: int = 7,
) -> FactorisationMachine:
    """Adaptive-gradient descent on the logistic loss, in small batches."""
    model = FactorisationMachine.empty(width, factors)
    if not len(rows):
        return model
    rng = np.random.default_rng(seed)
    model.factors = rng.normal(0, 0.02, (width, factors))
    rate_of = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model.bias = float(np.log(rate_of / (1 - rate_of)))
    seen_w, seen_v, seen_b = np.full(width, 1e-2), np.full((width, factors), 1e-2), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            texts = [rows[i] for i in part]
            sizes = np.array([len(t[0]) for t in texts])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ids, values = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
            margins, sums = model.margin(ids, values, starts)
            error = 1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[part]
            each = np.repeat(error, sizes) * values
            of = np.repeat(np.arange(len(part)), sizes)
            # All of a batch's gradients for one feature are added before its step.
            places, inverse = np.unique(ids, return_inverse=True)
            grad_w = np.bincount(inverse, weights=each, minlength=len(places)) + decay * model.weights[places]
            pushes = each[:, None] * (sums[of] - model.factors[ids] * values[:, None])
            grad_v = np.stack([np.bincount(inverse, weights=pushes[:, f], minlength=len(places)) for f in range(factors)], axis=1)
            grad_v += decay * model.factors[places]
            seen_w[places] += grad_w**2
            seen_v[places] += grad_v**2
            model.weights[places] -= rate * grad_w / np.sqrt(seen_w[places])
            model.factors[places] -= rate * grad_v / np.sqrt(seen_v[places])
            seen_b += float(error.sum() ** 2)
            model.bias -= rate * float(error.sum()) / seen_b**0.5
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
    label_col: str = "quality", learn: Column | None = None, max_rows: int = MAX_ROWS,
) -> FactorisationMachine:
    """A model of the labelled documents; ``learn`` says which label rows may be learned from."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    usable = usable if learn is None else usable.filter(learn)
    # At most max_rows label rows: small enough to send everywhere, at any size of input.
    chosen = (
        usable.select(F.col(id_col).alias("label_of"), F.col(label_col).cast("double").alias("label"))
        .orderBy(F.xxhash64("label_of"), "label_of", "label").limit(max_rows)
    )
    length = F.lit(None).cast("long") if length_col is None else F.col(length_col).cast("long")
    wanted = docs.select(F.col(id_col).alias("label_of"), F.col(text_col).alias("text"), length.alias("stored")).join(F.broadcast(chosen), "label_of")

    def extract(batches):
        for b in batches:
            names = b.schema.names
            rows = [features(t.as_py(), s.as_py())[0].astype(np.uint16).tobytes() for t, s in zip(b.column(names.index("text")), b.column(names.index("stored")))]
            kept = [b.column(names.index(c)) for c in ("label_of", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.binary())], ["label_of", "label", "ids"])

    id_type = wanted.schema["label_of"].dataType.simpleString()
    made = wanted.mapInArrow(extract, f"label_of {id_type}, label double, ids binary").withColumn("hash", F.xxhash64("ids", "label"))
    # One row for each id and label chosen: repeated documents do not make more rows than the bound.
    found = made.groupBy("label_of", "label").agg(F.min(F.struct("hash", "ids")).alias("r")).select("label", "r.hash", "r.ids").toArrow().combine_chunks()
    if not found.num_rows:
        return FactorisationMachine.empty()
    texts = found.column("ids").combine_chunks()
    sizes = pc.binary_length(texts).to_numpy() // 2
    flat = np.frombuffer(b"".join(texts.to_pylist()), np.uint16)
    y = found.column("label").to_numpy()
    # The order in which rows are learned follows their hashes, whatever tasks returned first.
    order = np.lexsort((y, found.column("hash").to_numpy()))
    rows = FlatRows(flat, np.append(0, np.cumsum(sizes)), order)
    del found, texts
    pa.default_memory_pool().release_unused()
    return fit(rows, y[order])


def score_of(text: Column, stored: Column | None, model: FactorisationMachine, spark: SparkSession) -> Column:
    """Score column: one value from 0 to 1 for every row, null and empty texts included."""
    shared = spark.sparkContext.broadcast(model)  # width x (factors + 1) doubles, fixed

    @F.arrow_udf("double")
    def score(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            rows = [features(t.as_py(), s.as_py()) for t, s in zip(texts[at : at + 256], lengths[at : at + 256])]
            sizes = [len(r[0]) for r in rows]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            out[at : at + len(rows)] = shared.value.score(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return pa.array(out)

    return score(text, F.lit(None).cast("long") if stored is None else stored.cast("long"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), score_of(F.col("text"), F.col("n_chars"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
