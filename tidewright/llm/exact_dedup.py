"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial in two prime fields over its bytes, with its length. Those of adjacent chunks
combine by length-shifted arithmetic, h(ab) = h(a) * r^|b| + h(b). Texts above HUGE bytes are split into rows of PART bytes,
which tasks hash apart, each hash being shifted by the length of what follows its chunk; the text's fingerprint is their sum.
Rows with equal fingerprints then undergo a chunkwise comparison with the copy that stays, in a stream: a task holds the
text of one representative and one batch. Texts whose fingerprint occurs once are left out by a Bloom filter and not shuffled.

Groups of any size are handled without gathering one: fingerprints are counted with a partial aggregation, members of a
group are dealt to one salt for each MEMBERS_PER_SALT of them, and only the representative goes to each salt. What a group
is told is joined to its members with salts too (`common.spread`).

Defined results: null text counts as empty; empty texts are equal to each other; of equal texts the row with the largest
doc_id stays (nulls lose); of repeated rows with that same id one stays; an empty table gives an empty result; further
columns, whatever their names, pass through `drop_copies` and are not read by `classes`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import free_names, lower_ascii, map_batches, spread
from tidewright.llm.graph import bloom, maybe_in
from tidewright.session import cut
from tidewright.sources import table

NAME = "op5_exact_dedup"
#: Two primes below 2^31 with a base each: sums of products stay below 2^64.
FIELDS = ((2147483647, 1_000_003), (2147483629, 69_069_069))
CHUNK = 1 << 15
HUGE, PART = 1 << 24, 1 << 22
MEMBERS_PER_SALT = 100
HOT_GROUPS = 10_000
_LEAST = -(1 << 63)
_SCHEMA = "doc_id long, fp long, size long, sha string"


def _powers(p: int, r: int) -> np.ndarray:
    out = np.ones(CHUNK, dtype=np.uint64)
    x = 1
    for i in range(CHUNK - 2, -1, -1):
        x = x * r % p
        out[i] = x
    return out


_TABLES: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, int, int]:
    """(hash, hash, length) of at most CHUNK bytes."""
    if not _TABLES:
        _TABLES.extend(_powers(p, r) for p, r in FIELDS)
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(b)
    return (*(int((b * t[CHUNK - n :]).sum() % np.uint64(p)) if n else 0 for (p, _), t in zip(FIELDS, _TABLES, strict=True)), n)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint of the concatenation; associative, with (0, 0, 0) as its unit."""
    return (*((x * pow(r, b[2], p) + y) % p for (p, r), x, y in zip(FIELDS, a, b, strict=False)), a[2] + b[2])


def fingerprint(data: bytes) -> tuple[int, int, int]:
    out = (0, 0, 0)
    for i in range(0, len(data), CHUNK):
        out = combine(out, chunk_hash(data[i : i + CHUNK]))
    return out


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8").lower()


def packed(mark: tuple[int, int, int]) -> int:
    """Both hashes of a fingerprint in one number of 62 bits."""
    return mark[0] << 31 ^ mark[1]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, fp, size, sha) of (doc_id, text); fp is null for huge texts, whose chunks are hashed apart."""
    for batch in batches:
        data = [normal(t) for t in batch.column(1).to_pylist()]
        fps = [packed(fingerprint(x)) if len(x) <= HUGE else None for x in data]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64()), "size": pa.array([len(x) for x in data], pa.int64()), "sha": pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())})


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, sha, first, a, b) of chunks (doc_id, size, sha, first, after, data): hashes times r^after."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("after", "data")}
        marks = [[x * pow(r, after, p) % p for (p, r), x in zip(FIELDS, fingerprint(data.lower()), strict=False)] for after, data in zip(c["after"], c["data"], strict=True)]
        yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in ("doc_id", "size", "sha", "first")} | {n: pa.array([m[i] for m in marks], pa.int64()) for i, n in enumerate("ab")})


def huge_prints(rows: DataFrame) -> DataFrame:
    """(doc_id, fp, size, sha) of rows(doc_id, text) with more than HUGE bytes: chunks are hashed in parallel and combined by sums."""
    data = F.col("data")
    size = F.octet_length("data").cast("long")
    big = rows.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data")).where(size > HUGE)
    named = big.select("doc_id", size.alias("size"), F.sha2(F.encode(lower_ascii(F.decode(data, "utf-8")), "utf-8"), 256).alias("sha"), data, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / PART))).alias("i"))
    at = F.col("i") * PART
    parts = named.select("doc_id", "size", "sha", (F.col("i") == 0).cast("int").alias("first"), F.greatest(F.col("size") - at - PART, F.lit(0)).alias("after"), F.substring("data", (at + 1).cast("int"), F.lit(PART)).alias("data"))
    hashed = map_batches(parts.repartition(F.col("doc_id"), F.col("sha"), F.col("after")), _shifted, "doc_id long, size long, sha string, first int, a long, b long")
    total = hashed.groupBy("doc_id", "size", "sha").agg(*[F.sum(n).alias(n) for n in ("first", "a", "b")])  # repeated rows: as many of each chunk
    fp = F.expr(f"shiftleft((a div first) % {FIELDS[0][0]}L, 31) ^ ((b div first) % {FIELDS[1][0]}L)")
    return total.select("doc_id", fp.alias("fp"), "size", "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("first"))).alias("copy")).drop("copy")


def same(a: bytes, b: bytes) -> bool:
    """Compares chunk by chunk, up to the first chunk that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fp, size, salt) with the representative first; yields those that differ from theirs."""
    key = head = None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("doc_id", "fp", "size", "salt", "sha", "data", "first")}
        out: list[tuple] = []
        for i, k in enumerate(zip(c["fp"], c["size"], c["salt"], strict=True)):
            if k != key:
                key, head = k, c["data"][i]
            elif not same(head, c["data"][i]):
                out.append((c["doc_id"][i], c["fp"][i], c["size"][i], c["sha"][i]))
        yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate((("doc_id", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("sha", pa.string())))})


def _texts(repeated: np.ndarray):
    """(doc_id, fp, size, sha, data) of the rows (doc_id, text) whose fingerprint may occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normal(t) for t in batch.column(1).to_pylist()]
            fps = np.array([packed(fingerprint(x)) for x in data], dtype=np.int64)
            at = [i for i in np.flatnonzero(maybe_in(repeated, fps.view(np.uint64))).tolist() if data[i]]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(at, pa.int64())),
                    "fp": pa.array(fps[at]),
                    "size": pa.array([len(data[i]) for i in at], pa.int64()),
                    "sha": pa.array([hashlib.sha256(data[i]).hexdigest() for i in at], pa.string()),
                    "data": pa.array([data[i] for i in at], pa.binary()),
                }
            )

    return run


class Classes:
    """The classes of equal texts of docs(doc_id, text)."""

    def __init__(self, docs: DataFrame):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        prints = cut(map_batches(rows, _prints, _SCHEMA))
        if not prints.where("fp is null").isEmpty():
            prints = prints.where("fp is not null").unionByName(cut(huge_prints(rows)))
        groups = cut(prints.groupBy("fp", "size").agg(F.count("*").alias("n"), F.max(F.coalesce("doc_id", F.lit(_LEAST))).alias("rep")).where("n > 1"))
        #: A Bloom filter of the fingerprints that occur more than once.
        self.repeated = bloom(groups, "fp", groups.count())
        odd = cut(map_batches(self._dealt(rows, groups.where("size > 0")), _compare, "doc_id long, fp long, size long, sha string"))
        if odd.isEmpty():
            self.keyed = prints.withColumn("cls", F.lit(""))
        else:  # texts that share a fingerprint but differ are classed by their SHA-256 as well
            clash = groups.join(odd.select("fp", "size").distinct(), ["fp", "size"], "left_semi").select("fp", "size", "n", F.lit(True).alias("clash"))
            self.keyed = spread(prints, clash, ["fp", "size"], "n", "left").withColumn("cls", F.when(F.col("clash"), F.col("sha")).otherwise("")).drop("clash", "n")
        #: (fp, size, cls, group_size, keep_id) of the classes of several rows.
        self.several = cut(self.keyed.groupBy("fp", "size", "cls").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"))

    def _dealt(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """The texts of groups, each member in one salt, the representative in front of each."""
        held = map_batches(rows, _texts(self.repeated), _SCHEMA + ", data binary")
        salts = F.ceil(F.col("n") / MEMBERS_PER_SALT).cast("int")
        heads = groups.select("fp", "size", F.col("rep").alias("id"), salts.alias("salts"))
        named = held.withColumn("id", F.coalesce("doc_id", F.lit(_LEAST)))
        first = named.join(heads, ["fp", "size", "id"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("first", F.lit(True))
        hot = heads.where("salts > 1").orderBy(F.desc("salts"), "fp", "size").limit(HOT_GROUPS).select("fp", "size", "salts")  # a fixed bound
        members = named.join(F.broadcast(hot), ["fp", "size"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))).withColumn("first", F.lit(False))
        names = ["doc_id", "fp", "size", "salt", "sha", "data", "first"]
        return first.select(names).unionByName(members.select(names)).repartition(F.col("fp"), F.col("size"), F.col("salt")).sortWithinPartitions("fp", "size", "salt", F.desc("first")).select(names)

    def rows(self) -> DataFrame:
        """(doc_id, keep_id, group_size, text_sha256, fp, size, cls) for each row."""
        told = spread(self.keyed, self.several, ["fp", "size", "cls"], "group_size", "left")
        return told.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("sha").alias("text_sha256"), "fp", "size", "cls")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, text_sha256, fp, size, cls) for each row of docs(doc_id, text)."""
    return Classes(docs).rows()


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that equal one which stays; all columns pass through. Of repeated rows one stays. Rows whose
    fingerprint occurs once stay where they are; the others alone are shuffled."""
    found = Classes(docs)
    repeated = found.repeated
    mark, some, who, its = free_names(docs, "sha", "repeated", "stays", "stays_sha")
    text = docs.columns.index("text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [normal(t) for t in b.column(text).cast(pa.string()).to_pylist()]
            shas = [hashlib.sha256(x).hexdigest() for x in data]
            fps = np.array([packed(fingerprint(x)) for x in data], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shas, pa.string()), pa.array(maybe_in(repeated, fps.view(np.uint64)))], names=[*b.schema.names, mark, some])

    named = map_batches(docs, told, T.StructType([*docs.schema.fields, T.StructField(mark, T.StringType()), T.StructField(some, T.BooleanType())]))
    stay = found.rows().where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(who), F.col("text_sha256").alias(its)).distinct()
    held, once = named.where(F.col(some)), named.where(~F.col(some))
    kept = held.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col(who)) & (F.col(mark) == F.col(its)), "left_semi").dropDuplicates(["doc_id", mark])
    return once.unionByName(kept).drop(mark, some)


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
