"""WARC archives: a writer that marks repeated payloads as revisits, and a salvage reader.

Writing: each row becomes one gzip member that holds one WARC/1.1 record; a block is an HTTP response. Of equal payloads of
at least MIN_REVISIT bytes the row with the smallest id is the response and the others refer to it; a revisit keeps the
HTTP headers only. Payloads whose digest occurs once (a Bloom filter tells) are written where they are read; the others are
shuffled to learn what they repeat, a digest with many rows in salts. Spark's text writer puts the members into files, with
a zero byte after each (gzip padding), in any store that Spark reaches; files hold FILE_RECORDS records at most, and fewer
where payloads are so large that a file could have more than FILE_BYTES.

Reading: members and plain records are checked (compression, header, length, block digest). After a failed check the
reader looks for the next place where a member or a version line begins and passes its checks, recovers what follows, and
reports the bytes between as a quarantined gap.

Defined results: null payload counts as empty; null url writes no target; repeated rows with the id of the response are
responses too; a null id is written as `null`, is response only if no other id has the payload, and is read as null;
an empty table writes nothing and reads as empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, spread
from tidewright.llm.graph import bloom, maybe_in
from tidewright.session import cut, delete, shared_folder
from tidewright.sources import table

NAME = "op10_warc"
MIN_REVISIT = 100
FILE_RECORDS, FILE_BYTES = 1000, 1 << 28
STEP = 1 << 16
MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    end: int


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record, not compressed. refers_to: the id of the response that a revisit repeats."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END + (payload if refers_to is None else b"")
    target = None if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    head += [("WARC-Target-URI", target)] if target is not None else []
    head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)] if refers_to is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _plain(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The plain record at `at`: (record, its end, reason if there is none)."""
    head = data.find(END, at)
    if head < 0:
        return None, at, "header without an end"
    lines = data[at:head].split(b"\r\n")
    if not lines[0][5:].replace(b".", b"").isdigit():
        return None, at, "bad version line"
    headers: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or not k:
            return None, at, "bad header line"
        headers[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, at, "no content length"
    start, end = head + 4, head + 4 + int(size)
    if end + 4 > len(data) or data[end : end + 4] != END:
        return None, at, "wrong length or truncated"
    block = data[start:end]
    kind, _, value = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != value:
        return None, at, "wrong block digest"
    return Record(headers, block, at, end + 4), end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The content of the member at `at`, and its end. Read in steps: the decompressor copies what follows the end in a step."""
    z, out = zlib.decompressobj(31), []
    try:
        for i in range(at, len(data), STEP):
            out.append(z.decompress(data[i : i + STEP]))
            if z.eof:
                return b"".join(out), min(i + STEP, len(data)) - len(z.unused_data)
    except zlib.error:
        pass
    return None, at


def salvage(data: bytes, inner: bool = False) -> Iterator[Record | Gap]:
    """The records and quarantined gaps of an archive, in order. Offsets of records in a member are the member's."""
    at, n, bad, why = 0, len(data), -1, ""

    def closed(end: int) -> Iterator[Gap]:
        nonlocal bad
        if bad >= 0:
            yield Gap(bad, end, why)
        bad = -1

    while at < n:
        found: list[Record | Gap] = []
        to, reason = at, "no record begins here"
        if not inner and data.startswith(MAGIC, at):
            out, to = _member(data, at)
            reason = "broken gzip member"
            if out is not None:
                found = list(salvage(out, True))
                if not any(isinstance(x, Record) for x in found):
                    to, reason = at, found[0].reason if found else "empty member"
        elif data.startswith(VERSION, at):
            rec, to, reason = _plain(data, at)
            found = [rec] if rec else []
        elif data[at] in (0, 13, 10) and bad < 0:
            at += 1
            continue
        if to > at:
            yield from closed(at)
            for x in found:
                yield x if not (to > at and data.startswith(MAGIC, at)) or inner else (Record(x.headers, x.block, at, to) if isinstance(x, Record) else Gap(at, to, x.reason))
            at = to
            continue
        if bad < 0:
            bad, why = at, reason
        places = [p for p in (data.find(VERSION, at + 1), -1 if inner else data.find(MAGIC, at + 1)) if p >= 0]
        at = min(places, default=n)
    yield from closed(n)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes a record for each row into archives below `path`."""
    data = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), data.alias("data")).withColumn("digest", F.sha2("data", 256))
    name = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")  # 60 bits of the digest
    size = F.octet_length("data").cast("long")
    marks = cut(rows.select("digest", name.alias("name"), F.col("id"), size.alias("size")).groupBy("digest", "name").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size")))
    most = marks.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    first = cut(marks.where(f"n > 1 and size >= {MIN_REVISIT}").select("digest", "name", "first", "n"))
    repeated = bloom(first, "name", first.count())

    def built(c: list[list], refers: list) -> pa.RecordBatch:
        out = [member(record("null" if i is None else str(i), u, d, s, None if r is None else str(r))) for i, u, d, s, r in zip(*c, refers, strict=True)]
        return pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    def some(b: pa.RecordBatch, wanted: bool) -> pa.RecordBatch:
        """Rows whose payload may be repeated, or the others."""
        names = np.array([int(x[:15], 16) for x in b.column(3).to_pylist()], dtype=np.uint64)
        long = np.array([x >= MIN_REVISIT for x in pc.binary_length(b.column(2)).to_pylist()], dtype=bool)
        return b.filter(pa.array((maybe_in(repeated, names) & long) == wanted))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = some(b, False)
            yield built([x.to_pylist() for x in b.columns], [None] * b.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield some(b, True)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield built([x.to_pylist() for x in b.columns[:4]], b.column(4).to_pylist())

    several = spread(map_batches(rows, maybe, "id long, url string, data binary, digest string"), first.drop("name"), ["digest"], "n", "left", by=["id", "url"])
    several = several.select("id", "url", "data", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))
    members = map_batches(rows, single, "value binary").unionByName(map_batches(several, told, "value binary"))
    held = max(1, min(FILE_RECORDS, FILE_BYTES // (most + 1024)))
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", held).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record (gap null) and each quarantined gap (gap: its reason) of the archives below `path`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, start long, end long, gap string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        x = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def row(file: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (file, x.start, x.end, x.reason, *[None] * 7)
        h = x.headers
        head, _, body = x.block.partition(END)
        kind = h.get("warc-type")
        told = next((int(line[15:]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(body))
        digest = hashlib.sha256(body).hexdigest() if kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha256:")
        return (file, x.start, x.end, None, number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, len(body) if kind == "response" else told, digest, number(h.get("warc-refers-to")), body if kind == "response" else None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                for x in salvage(data.as_buffer().to_pybytes() if data.is_valid else b""):
                    rows.append(row(file, x))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_batches(files, parse, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Of archives that were just written, a gap or a row more or less is an error, not a shorter result."""
    path, pages = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}", table(spark, folder, "pages")
    write(pages, path)
    out = cut(read(spark, path).select("gap", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    told = out.agg(F.count_if(F.col("gap").isNotNull()), F.count("*")).first()
    delete(spark, path)
    if told[0] or told[1] != (n := pages.count()):
        raise RuntimeError(f"{told[1] - told[0]} records and {told[0]} gaps were read of {n} pages written")
    return out.drop("gap")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
