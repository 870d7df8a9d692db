"""Line deduplication by content-defined line chunks and by passages of whole lines.

A text's lines are hashed; a rolling hash over the hashes of each line and the one before it chooses boundaries, so that
lines added or removed in front don't shift those that follow. Chunks of at least MIN_LINES lines and MIN_BYTES bytes are
segments of the text. A boundary falls on every second line on average, and a run of repeated lines hence has the same
chunks wherever it stands, but for its first and last.

So that a repeated passage of over WORDS words is found wherever boundaries fall, these are segments too: from each line on,
and up to each line, the least run of lines with over WORDS words. Every run of lines with over WORDS words is the union of
those that lie in it, and they depend on its lines alone, so all of it goes, to the line, if it has stood before.

Segments that occur more than once over all documents are compared byte by byte with their first occurrence (by doc_id, the
text's hash, then place) and, if equal, removed; the first stays. Where an occurrence overlaps the first, only the lines after the first go.

Texts without a repeated segment, and those that lose nothing, are told by Bloom filters and not shuffled. No group is
gathered: occurrences are counted by a partial aggregation and told of it with salts, members are dealt to one salt for each
MEMBERS_PER_SALT, and the first occurrence alone goes to all salts.

Defined results: null text stays null, with no lines removed; empty texts stay; a text all of whose lines go is empty;
repeated rows of an id with one text are occurrences of the same places, so their segments are not removed for each other's
sake; rows of one id with different texts, a null id among them, are rows of their own; a null id counts as the largest; the
order of lines that stay is kept; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches, spread
from tidewright.llm.graph import bloom, maybe_in
from tidewright.session import cut
from tidewright.sources import table

NAME = "op7_line_dedup"
BOUNDARY = 2
MIN_LINES = 2
MIN_BYTES = 40
WORDS = 50
MEMBERS_PER_SALT = 100
_LAST = (1 << 63) - 1


def chunks(text: str | None) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk of a text."""
    return _chunks([xxhash.xxh3_64_intdigest(x) for x in text.split("\n")]) if text else []


def _chunks(h: list[int]) -> list[tuple[int, int]]:
    out, start = [], 0
    for i in range(len(h)):
        rolled = (h[i] * 0x9E3779B97F4A7C15 + (h[i - 1] if i else 0) * 0xC2B2AE3D27D4EB4F) >> 17 & 0xFFFFFF
        if i + 1 == len(h) or (i + 1 - start >= MIN_LINES and rolled % BOUNDARY == 0):
            out.append((start, i + 1))
            start = i + 1
    return out


def _passages(counts: list[int]) -> list[tuple[int, int]]:
    """The least runs of over WORDS words from each line on and up to each line, given the lines' numbers of words."""
    total = np.concatenate(([0], np.cumsum(counts)))
    ends, starts = np.searchsorted(total, total[:-1] + WORDS, side="right"), np.searchsorted(total, total[1:] - WORDS, side="left") - 1
    return [(a, b) for a, b in enumerate(ends.tolist()) if b <= len(counts)] + [(a, b + 1) for b, a in enumerate(starts.tolist()) if a >= 0]


class Lines:
    """A text's lines as bytes, and its segments: (first line, line after the last)."""

    def __init__(self, text: str | None):
        self.lines = text.encode("utf-8", "replace").split(b"\n") if text else []
        self.hashes = [xxhash.xxh3_64_intdigest(x) for x in self.lines]
        self.packed = np.array(self.hashes, dtype=np.uint64).tobytes()
        self.ends = np.concatenate(([0], np.cumsum([len(x) + 1 for x in self.lines]))).astype(int).tolist()

    def mark(self, a: int, b: int) -> tuple[int, int]:
        """(hash, bytes) of a run of lines."""
        return xxhash.xxh3_64_intdigest(self.packed[8 * a : 8 * b]) - (1 << 63), self.ends[b] - self.ends[a] - 1

    def has(self, a: int, b: int, mark: tuple[int, int]) -> bool:
        """Whether the run is there and has this mark."""
        return b <= len(self.lines) and self.mark(a, b) == mark

    def segments(self) -> list[tuple[int, int]]:
        if not self.lines:
            return []
        found = {(a, b) for a, b in _chunks(self.hashes) if b - a >= MIN_LINES and self.ends[b] - self.ends[a] - 1 >= MIN_BYTES}
        return sorted(found.union(_passages([len(x.split()) for x in self.lines])))


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)], names=list(fields))


_ROW = {"id": pa.int64(), "row": pa.int64()}
_PLACE = _ROW | {"start": pa.int32(), "stop": pa.int32()}
_MARK = {"hash": pa.int64(), "size": pa.int64()}
_PLACED = "id long, row long, start int, stop int, hash long, size long"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, r, t in zip(*(b.column(n).to_pylist() for n in ("id", "row", "text")), strict=True):
            x = Lines(t)
            rows += [(d, r, i, j, *x.mark(i, j)) for i, j in x.segments()]
        yield _batch(rows, _PLACE | _MARK)


def _data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that `cand` names: structs of start, stop, hash, size, salts and whether it is the first."""
    for b in batches:
        for d, r, t, cand in zip(*(b.column(n).to_pylist() for n in ("id", "row", "text", "cand")), strict=True):
            x = Lines(t)
            rows = [(d, r, c["start"], c["stop"], c["hash"], c["size"], c["salts"], c["first"], b"\n".join(x.lines[c["start"] : c["stop"]])) for c in cand if x.has(c["start"], c["stop"], (c["hash"], c["size"]))]
            yield _batch(rows, _PLACE | _MARK | {"salts": pa.int32(), "first": pa.bool_(), "data": pa.binary()})


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hash, size, salt), the first occurrence in front; yields the members that equal it, and from which line on they go."""
    key = head = None
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("id", "row", "start", "stop", "hash", "size", "salt", "first", "data")}
        out: list[tuple] = []
        for i, k in enumerate(zip(c["hash"], c["size"], c["salt"], strict=True)):
            own = c["id"][i], c["row"][i]
            if c["first"][i]:
                if k != key or head is None:
                    key, head = k, (c["data"][i], own, c["stop"][i])
            elif k == key and c["data"][i] == head[0]:
                gone = max(c["start"][i], head[2]) if own == head[1] else c["start"][i]
                if gone < c["stop"][i]:
                    out.append((*own, c["start"][i], c["stop"][i], c["hash"][i], c["size"][i], gone))
        yield _batch(out, _PLACE | _MARK | {"gone": pa.int32()})


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for d, t, drop in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("drop").to_pylist(), strict=True):
            gone: set[int] = set()
            if drop:
                x = Lines(t)
                for c in drop:
                    if x.has(c["start"], c["stop"], (c["hash"], c["size"])):
                        gone.update(range(c["gone"], c["stop"]))
                if gone:
                    t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
            rows.append((None if d == _LAST else d, t, len(gone)))
        yield _batch(rows, {"doc_id": pa.int64(), "text": pa.string(), "lines_removed": pa.int32()})


_ROWS = "id long, row long, text string"


def _filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the texts' hashes."""
    return bloom(rows, "row", rows.count())


def _among(wanted: np.ndarray, there: bool):
    """The rows (id, row, text) that may be among those wanted, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(wanted, b.column("row").to_numpy().view(np.uint64)) == there))

    return run


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lines_removed) of docs(doc_id, text)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    place = F.struct("id", "row", "start", "stop")
    marks = cut(map_batches(rows, _hashes, _PLACED))
    groups = cut(marks.groupBy("hash", "size").agg(F.count("*").alias("n"), F.min(place).alias("head")).where("n > 1"))
    named = spread(marks, groups, ["hash", "size"], "n").select("id", "row", F.struct("start", "stop", "hash", "size", F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("int").alias("salts"), (place == F.col("head")).alias("first")).alias("c"))
    cand = cut(named.groupBy("id", "row").agg(F.collect_set("c").alias("cand")))  # at most three for each line of a text
    held = map_batches(map_batches(rows, _among(_filter(cand), True), _ROWS).join(cand, ["id", "row"]), _data, f"{_PLACED}, salts int, first boolean, data binary")
    salt = F.when(F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "row", "start"), F.col("salts")).cast("int")))
    dealt = held.withColumn("salt", F.explode(salt)).repartition(F.col("hash"), F.col("size"), F.col("salt")).sortWithinPartitions("hash", "size", "salt", F.desc("first"))
    drops = cut(map_batches(dealt, _equal, f"{_PLACED}, gone int").groupBy("id", "row").agg(F.collect_set(F.struct("start", "stop", "hash", "size", "gone")).alias("drop")))
    less = _filter(drops)
    whole = map_batches(rows, _among(less, False), _ROWS).select(F.nullif("id", F.lit(_LAST)).alias("doc_id"), "text", F.lit(0).alias("lines_removed"))
    return whole.unionByName(map_batches(map_batches(rows, _among(less, True), _ROWS).join(drops, ["id", "row"], "left"), _rebuild, "doc_id long, text string, lines_removed int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(table(spark, folder, "documents").select("doc_id", "text"))
