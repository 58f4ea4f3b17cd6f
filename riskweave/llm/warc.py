"""WARC archives: a writer with revisit records, and a salvage reader.

Writer: one gzip member per record. Of records with equal payloads the one with the largest
id is a ``response``; the others are ``revisit`` records that name it and carry headers only.
Each task writes one file of its own name into the shared folder and reports it; only
reported files are read, so a task that ran twice does no harm.

Reader: files are cut into byte ranges, one task each. A range is read from the first valid
record that starts in it. Where a member or record fails a check (compression, lengths, digest), the
reader looks for the next valid member or version line, goes on from there, and the bytes
between are logged as a quarantined gap. Compressed and plain archives are told apart by
their bytes.

Cases: a null payload is the empty one. Payloads below ``least`` bytes never become revisits.
A null id is smaller than any other and never referred to unless all ids are null, when all
such records are responses; repeated rows (equal id and payload) are all responses if their
id is the largest. A null url is left out. An empty table gives an empty archive and no rows.
Other columns are not read. Payloads of any length are written and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskweave.llm.common import ship, table
from riskweave.session import fresh_path, materialise

RANGE_BYTES = 16 << 20
MANIFEST = "path string, bytes long, records long"
RECORDS = (
    "path string, bytes long, offset long, until long, record_type string, page_id long, url string, "
    "payload binary, payload_bytes long, payload_digest string, refers_to long"
)
_CHUNK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d+|null)>")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def assign_types(pages: DataFrame, id_col: str, url_col: str | None, payload_col: str, least: int) -> DataFrame:
    """page_id, url, payload, refers_to, revisit of every row."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        (F.lit(None).cast("string") if url_col is None else F.col(url_col)).alias("url"),
        payload.alias("payload"),
    ).withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    # One row per repeated payload, counted before the shuffle; hot payloads are single rows.
    repeated = rows.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = repeated.filter("n > 1 and first_id is not null").select("sha", "first_id")
    joined = rows.join(repeated, "sha", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
    least: int = 0, compress: bool = True, date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write one archive per task into ``folder`` and return the written manifest of files."""
    spark = pages.sparkSession
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc" + (".gz" if compress else "")
        size = count = 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                for page_id, url, payload, refers_to, revisit in zip(*(b.column(i) for i in range(5))):
                    raw = record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py(), date)
                    raw = _member(raw) if compress else raw
                    out.write(raw)
                    size += len(raw)
                    count += 1
        if count:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    typed = assign_types(pages, id_col, url_col, payload_col, least)
    return materialise(typed.mapInArrow(write, MANIFEST), "warc-manifest")


class _Source:
    """Bytes of a file by place, read in chunks and the last one kept."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at = at
            self.held = self.file.read_at(min(max(n, _CHUNK), max(0, self.size - at)), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]


@dataclass
class _Record:
    until: int
    head: dict[str, str]
    payload: bytes
    length: int


def _parse(raw_head: bytes) -> dict[str, str] | None:
    lines = raw_head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _checked(head: dict[str, str], block: bytes, until: int) -> _Record | None:
    """The record, if type, id, digests and lengths agree."""
    if head.get("warc-type") not in ("response", "revisit") or not _ID.fullmatch(head.get("warc-record-id", "")):
        return None
    if head.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
        return None
    http, blank, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if not blank or not length:
        return None
    if head["warc-type"] == "response" and (int(length[1]) != len(payload) or head.get("warc-payload-digest") != f"sha1:{sha1_base32(payload)}"):
        return None
    return _Record(until, head, payload, int(length[1]))


def _plain_at(source: _Source, at: int) -> _Record | None:
    if not _VERSION.match(source.read(at, 10)):
        return None
    size = 1 << 12
    while (end := (raw := source.read(at, size)).find(b"\r\n\r\n")) < 0:
        if len(raw) < size or size > 1 << 20:
            return None
        size *= 4
    head = _parse(raw[:end])
    if not head.get("content-length", "").isdigit():
        return None
    start, length = at + end + 4, int(head["content-length"])
    if start + length + 4 > source.size:
        return None
    body = source.read(start, length + 4)
    return _checked(head, body[:length], start + length + 4) if body[length:] == b"\r\n\r\n" else None


def _member_at(source: _Source, at: int) -> _Record | None:
    if source.read(at, 3) != _MAGIC:
        return None
    unpacker, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            chunk = source.read(place, 1 << 16)
            if not chunk:
                return None
            parts.append(unpacker.decompress(chunk))
            if len(parts) == 1 and not _VERSION.match(parts[0][:10]):
                return None
            place += len(chunk)
    except zlib.error:
        return None
    raw = b"".join(parts)
    head_end = raw.find(b"\r\n\r\n")
    head = _parse(raw[:head_end]) if head_end > 0 else None
    if head is None or not raw.endswith(b"\r\n\r\n") or head.get("content-length") != str(len(raw) - head_end - 8):
        return None
    return _checked(head, raw[head_end + 4 : -4], place - len(unpacker.unused_data))


def _next_sign(source: _Source, at: int, stop: int) -> int:
    """The first place from ``at`` and before ``stop`` that looks like a record's start, or ``stop``."""
    while at < stop:
        piece = source.read(at, _CHUNK)[: stop - at + 10]
        if not piece:
            return stop
        line = _VERSION.search(piece)
        found = [x for x in (piece.find(_MAGIC), line.start() if line else -1) if x >= 0]
        if found:
            return min(stop, at + min(found))
        at += max(1, len(piece) - 9)
    return stop


def salvage(path: str, start: int, stop: int) -> Iterator[tuple[int, _Record]]:
    """(offset, record) of the valid records that start in [start, stop)."""
    source = _Source(path)
    stop = min(stop, source.size)
    at = start
    while at < stop:
        found = _member_at(source, at) or _plain_at(source, at)
        if found:
            yield at, found
            at = found.until
        else:
            at = _next_sign(source, at + 1, stop)


def _number(text: str | None) -> int | None:
    m = _ID.fullmatch(text or "")
    return int(m[1]) if m and m[1] != "null" else None


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All valid records of the listed files (columns path, bytes), read range by range."""
    ship(manifest.sparkSession)
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("from"))
    spread = ranges.repartition("path", "from")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [("path", pa.string()), ("bytes", pa.int64()), ("offset", pa.int64()), ("until", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
            + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        )
        for b in batches:
            for path, size, first in zip(*(c.to_pylist() for c in b.columns)):
                rows: list[tuple] = []
                held = 0
                for offset, r in salvage(path, first, first + range_bytes):
                    kind = r.head["warc-type"]
                    digest = r.head.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = r.payload if kind == "response" else None
                    rows.append((path, size, offset, r.until, kind, _number(r.head["warc-record-id"]), r.head.get("warc-target-uri"), payload, r.length, digest, _number(r.head.get("warc-refers-to"))))
                    held += len(r.payload)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return spread.mapInArrow(read, RECORDS)


def _in_file() -> Window:
    return Window.partitionBy("path").orderBy("offset")


def settle(records: DataFrame) -> DataFrame:
    """Without records that lie inside an earlier one (a payload may hold an archive itself)."""
    before = F.max("until").over(_in_file().rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).filter("offset >= before").drop("before")


def gaps(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Quarantined byte gaps: path, from, until (half open)."""
    spans = records.select("path", "offset", "until")
    ends = manifest.select("path", F.col("bytes").alias("offset"), F.col("bytes").alias("until"))
    before = F.coalesce(F.max("until").over(_in_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return spans.unionByName(ends).select("path", before.alias("from"), F.col("offset").alias("until")).filter("from < until")


def whole(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """The settled records of archives in which none may be missing; the gaps are logged in the shared folder."""
    log, kept = materialise(gaps(manifest, records), "warc-gaps"), settle(records)
    n_gaps, lost = log.agg(F.count(F.lit(1)), F.sum(F.col("until") - F.col("from"))).first()
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, kept.count()
    if n_gaps or read != written:
        raise ValueError(f"{written} records were written and {read} read; {n_gaps} gaps of {lost or 0} bytes, logged in {log.inputFiles()[:1]}")
    return kept


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    records = materialise(read_archives(manifest).drop("payload", "url"), "warc-records")
    return whole(manifest, records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
