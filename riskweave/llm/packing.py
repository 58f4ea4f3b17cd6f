"""Packing by power-of-two decomposition.

A document of ``n`` ids is cut into pieces whose lengths are the powers of two of ``n``:
as many of the full length as fit, then the binary digits of the rest, longest first. A
piece is a whole sequence of its bucket (all sequences of one length together), so no
sequence holds two documents and none needs padding.

Cases: a null or empty text is its end id alone, one piece of length 1. Repeated rows and
repeated or null ids each give pieces of their own, with sequence ids of their own. An empty
table gives no rows. Other columns of the input are not read, whatever their names. A very
long text is tokenised chunk by chunk, cut where the tokeniser's pre-tokeniser always cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweave.llm.common import table

FULL = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"

_CUT = re.compile(r"(?<=\S)(?=\s)")


def piece_lengths(n: int, full: int = FULL) -> list[int]:
    """Lengths that add up to ``n``: full ones, then the binary digits of the rest."""
    rest = n % full
    return [full] * (n // full) + [1 << b for b in range(full.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """Ids of whole texts, without end ids.

    ``path`` is the tokeniser that defines them. Its vocabulary may also lie in a file of
    ranks, which a second library reads several times as fast. That one is used for texts whose
    characters all come before U+0250, where the two libraries' character tables are the same;
    all others go to the tokeniser itself.
    """

    CHUNK = 1 << 20
    _BEYOND = re.compile("[^\x00-\u024f]").search

    def __init__(self, path: str, ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.quick = None
        if ranks is not None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})

    def _whole(self, text: str) -> bytes:
        if self.quick is not None and not self._BEYOND(text):
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A long text is cut before blanks that follow a
        non-blank, where the pre-tokeniser always cuts."""
        if len(text) <= self.CHUNK:
            return self._whole(text) if text else b""
        parts, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, start + self.CHUNK) if start + self.CHUNK < len(text) else None
            end = cut.start() if cut else len(text)
            parts.append(self._whole(text[start:end]))
            start = end
        return b"".join(parts)


_ENCODERS: dict[str | None, Encoder] = {}


def _encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        if path is None:
            import public_tokenizers as public

            _ENCODERS[path] = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))
        else:
            _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: int = FULL, end_id: int = END_ID, tokenizer_path: str | None = None
) -> DataFrame:
    """One row per piece: its document, place, length, ids, and its sequence.

    ``ids`` holds little-endian unsigned 32-bit ids. ``sequence_id`` is unique within one run
    of the plan; no rows move, so a task that runs again gives the same numbers.
    """
    if full & (full - 1):
        raise ValueError("the full length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, full):
                    for column, value in zip(out, (key, start, length, ids[4 * start : 4 * (start + length)], n)):
                        column.append(value)
                    start += length
                held += len(ids)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)
                    out, held = ([], [], [], [], []), 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in one folder per length, ready for batches without padding."""
    packed.withColumn("bucket", F.col("length").cast("int")).write.partitionBy("bucket").parquet(path)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
