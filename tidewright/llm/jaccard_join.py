"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its k-word shingles, hashed to 64 bits, in one order: rare tokens first, frequent ones (held by at
least FREQUENT documents) last. Two linked sets share a rare token among their first n - ceil(t n) + 1, which is indexed
alone, or none but frequent tokens. Then combinations of two frequent tokens are indexed, from an extended prefix. In the
merged order of both sets' frequent tokens at most D are in one set alone, D <= o (1/t - 1) for an overlap of o; so of the
first D + 2 common ones two stand side by side in both sets (for t >= 3/4, where o >= D + 2 follows). Pairs of neighbours
in a prefix of 2 (n - ceil(t n)) + o (1/t - 1) + 2 hence find every link, and a set's keys grow with its size, not with its
square. (For lesser t all pairs of the prefix that holds the first two common tokens are indexed.) Tokens of passages that
many documents share so never make a bucket by themselves.

Steps: (1) One pass finds each document's class (equal sets: one class, by a hash of the set) and counts tokens by
blocks; the sum over blocks gives the frequent ones. Any choice of frequent tokens gives the same links, so at most
MAX_FREQUENT are sent to the tasks. (2) Index keys of all classes are counted; those of one class only are dropped by a
Bloom filter before the rest is shuffled. (3) Each class is verified against one hub: of the buckets' first classes (those
whose key stands foremost) the one it meets most often. Near copies of a text so fall into one component with as many
verifications as copies. (4) What stays are buckets with several components. In those of at most BUCKET classes, pairs of
classes in different components that pass the length and position filters are verified. Larger ones are taken up in
rounds: at most HUBS of a bucket's classes are paired with all others and leave it. A round's pairs are at most HUBS for
each entry of the index, and no pair within a component of the first links is ever made. (5) Components of all verified links by alternating stars. Joins by a key that many rows hold are salted.

Verification first bounds the overlap from above: the counts of a set's tokens by the first bits of their hashes are a
sketch of a byte for about three tokens, and the sum of the lesser counts is at least the overlap. Pairs that pass are
compared by their whole sets. Sets of classes that no such pair names are not shuffled (a Bloom filter again).

Defined results: null, empty and wordless texts have no shingles and are their own components; repeated rows of an id are
in one component with the id; a null id counts as the largest and stays null; an empty table gives an empty result; other
columns, whatever their names, are not read, but pass through `keep_one`. Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import free_names, map_batches, shingles, spread
from tidewright.llm.graph import bloom, components, maybe_in
from tidewright.session import cut
from tidewright.sources import table

NAME = "op6_jaccard_join"
FREQUENT = 50
MAX_FREQUENT = 1_000_000
BLOCK_TOKENS = 4_000_000
BUCKET = HUBS = 1024
SENT_IDS = 1_000_000  # as many ids at most are broadcast; more are joined by a shuffle
_LAST = (1 << 63) - 1


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n with any that links."""
    return -(-num * n // den)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (y * np.uint64(0x9E3779B97F4A7C15))
        k ^= k >> np.uint64(31)
        return k * np.uint64(0xD6E8FEB86659FD93)


def index_keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (single rare tokens and pairs of frequent ones), the place of their first token in the order, and its place among
    the frequent ones where tokens that both sets hold may precede a common key. frequent: sorted."""
    n = len(s)
    if n < 2:  # equal sets are one class
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    at = np.searchsorted(frequent, s)
    often = frequent[np.minimum(at, len(frequent) - 1)] == s if len(frequent) else np.zeros(n, dtype=bool)
    rare, common = s[~often], s[often]
    p = n - needed(n, num, den) + 1
    keys, places = [rare[:p]], [np.arange(min(p, len(rare)), dtype=np.int32)]
    leads = [np.zeros(len(places[0]), dtype=np.int32)]
    if 4 * num >= 3 * den:
        single = len(common) * (den - num) // num - len(rare)  # frequent tokens that one of two linked sets alone holds, at most
        own = min(single, len(common) - needed(n, num, den))
        if own >= 0:
            c = common[: own + single + 2]
            keys.append(_pair(c[:-1], c[1:]))
            places.append(np.arange(len(rare), len(rare) + len(c) - 1, dtype=np.int32))
            leads.append(np.arange(len(c) - 1, dtype=np.int32))
    else:
        c = common[: max(0, p + 1 - len(rare))]
        for i in range(min(len(c) - 1, p - len(rare))):
            keys.append(_pair(c[i], c[i + 1 :]))
            places.append(np.full(len(c) - i - 1, len(rare) + i, dtype=np.int32))
            leads.append(np.zeros(len(c) - i - 1, dtype=np.int32))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(leads)


def sketch(s: np.ndarray) -> bytes:
    """Counts of tokens by their first bits. Empty where a count doesn't fit a byte."""
    bits = min(20, max(4, (len(s) // 3).bit_length()))
    c = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8).tobytes() if len(s) and c.max() < 256 else b""


def at_most(x: bytes, y: bytes) -> int:
    """An upper bound of the overlap of the sets with these sketches."""
    if not x or not y:
        return 1 << 40
    a, b = np.frombuffer(x, dtype=np.uint8).astype(np.int32), np.frombuffer(y, dtype=np.uint8).astype(np.int32)
    size = min(len(a), len(b))
    return int(np.minimum(a.reshape(size, -1).sum(1), b.reshape(size, -1).sum(1)).sum())


def _scan(k: int):
    """Rows (kind 0: doc_id, n, class, sketch) and (kind 1: token, 0, count in a block, where it is 2 or more)."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("n", pa.int32()), ("b", pa.int64()), ("sketch", pa.binary())])

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        v, c = np.unique(np.concatenate(held), return_counts=True)
        v, c = v[c > 1], c[c > 1]
        for i in range(0, len(v), 100_000):
            part = v[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int8)), pa.array(part.view(np.int64)), pa.array(np.zeros(len(part), np.int32)), pa.array(c[i : i + 100_000].astype(np.int64)), pa.nulls(len(part), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()
        for b in batches:
            rows = []
            for d, s in zip(b.column(0).to_pylist(), (shingles(t, k) for t in b.column(1).to_pylist()), strict=True):
                c = class_of(s)
                rows.append((0, d, len(s), c, sketch(s)))
                if len(s) and c not in seen:  # copies in a block count once
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
            if size > BLOCK_TOKENS:
                yield from counted(held)
                held, size, seen = [], 0, set()
        if held:
            yield from counted(held)

    return run


def _index(k: int, frequent: np.ndarray, num: int, den: int, among: np.ndarray | None):
    """Rows (key, class, n, place, lead); among: a Bloom filter of the keys wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, done = [], set()
            for s in (shingles(t, k) for t in b.column(1).to_pylist()):
                c = class_of(s)
                if c in done:
                    continue
                done.add(c)
                keys, places, leads = index_keys(s, frequent, num, den)
                if among is not None and len(keys):
                    hit = maybe_in(among, keys)
                    keys, places, leads = keys[hit], places[hit], leads[hit]
                for i in range(0, len(keys), 100_000):
                    parts.append((keys[i : i + 100_000], places[i : i + 100_000], c, len(s), leads[i : i + 100_000]))
            while parts:
                now, size = [], 0
                while parts and size < 100_000:
                    now.append(parts.pop())
                    size += len(now[-1][0])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(np.concatenate([x[0] for x in now]).view(np.int64)),
                        "cls": pa.array(np.concatenate([np.full(len(x[0]), x[2], dtype=np.int64) for x in now])),
                        "n": pa.array(np.concatenate([np.full(len(x[0]), x[3], dtype=np.int32) for x in now])),
                        "place": pa.array(np.concatenate([x[1] for x in now])),
                        "lead": pa.array(np.concatenate([x[4] for x in now])),
                    }
                )

    return run


def _named(cls: int, doc: int) -> int:
    """Spark's xxhash64(cls, doc)."""
    return xxhash.xxh64_intdigest(struct.pack("<q", doc), xxhash.xxh64_intdigest(struct.pack("<q", cls), 42))


def _sets(k: int, wanted: np.ndarray):
    """Rows (class, set as bytes) of the documents that stand for the classes wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, s in zip(b.column(0).to_pylist(), (shingles(t, k) for t in b.column(1).to_pylist()), strict=True):
                if len(s) and maybe_in(wanted, np.array([_named(c := class_of(s), d)], dtype=np.uint64))[0]:
                    out.append((c, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["cls", "set"])

    return run


def _checked(num: int, den: int, bound: bool):
    """The pairs (a, b) with sets x, y that link; bound: with sketches, that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, c, x, y, m, n in zip(*(b.column(n).to_pylist() for n in ("a", "b", "x", "y", "m", "n")), strict=True):
                if bound:
                    both = min(m, n, at_most(x, y))
                else:
                    both = m + n - len(np.unique(np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))))
                if den * both >= num * (m + n - both):
                    out.append((a, c))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])

    return run


def _fits(a: tuple[Column, ...], b: tuple[Column, ...], num: int, den: int) -> Column:
    """Whether lengths and the places (n, place, lead) of a common key allow for the overlap that a link needs: what follows
    the key, and what may precede it. For the first frequent neighbours in common, tokens of one set alone stand between any
    common ones before them, so of both leads together at most a third are tokens in common."""
    (na, pa_, la), (nb, pb, lb) = a, b
    alpha = F.ceil((F.lit(num) * (na + nb)) / F.lit(num + den))
    before = F.least(la, lb, F.floor((la + lb) / 3))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (before + F.least(na - pa_, nb - pb) >= alpha)


def _at(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("n", "place", "lead"))


class Join:
    """The links of docs(doc_id, text): sets of k-word shingles with den * intersection >= num * union."""

    def __init__(self, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100):
        self.k, self.num, self.den = k, num, den
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
        scan = cut(map_batches(self.rows, _scan(k), "kind byte, a long, n int, b long, sketch binary"))
        #: (doc_id, n, cls, sketch) for each row.
        self.docs = scan.where("kind = 0").select(F.col("a").alias("doc_id"), "n", F.col("b").alias("cls"), "sketch")
        often = scan.where("kind = 1").groupBy("a").agg(F.sum("b").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "a").limit(MAX_FREQUENT).select("a").toArrow()["a"].to_numpy()
        self.frequent = np.sort(often.view(np.uint64))

    def _checked(self, pairs: DataFrame, rows: DataFrame, bound: bool) -> DataFrame:
        """The pairs that pass, by rows(cls, n, v: sketch or set). A class that many pairs name, such as a hub, is sent to several tasks."""
        side = lambda *to: rows.select(*[F.col(c).alias(n) for c, n in zip(("cls", "v", "n"), to, strict=True)])
        hubs = cut(pairs.groupBy("b").agg(F.count("*").alias("met")).join(side("b", "y", "n"), "b"))
        told = spread(pairs.join(side("a", "x", "m"), "a"), hubs, ["b"], "met", by=["a"])
        return cut(map_batches(told.select("a", "b", "x", "y", "m", "n"), _checked(self.num, self.den, bound), "a long, b long"))

    def _stand(self, pairs: DataFrame) -> DataFrame:
        """(cls, doc_id, n, v: sketch) of the classes that pairs name, by the first document of each."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        first = self.docs.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(named, "cls")
        return self.docs.join(first, ["cls", "doc_id"]).groupBy("cls", "doc_id").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("v"))

    def _close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that may link, by their sketches."""
        return self._checked(pairs, cut(self._stand(pairs)).drop("doc_id"), True)

    def _linked(self, close: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets: one pass over the documents."""
        names = cut(self._stand(close).select(F.xxhash64("cls", "doc_id").alias("name")))
        wanted = bloom(names, "name", names.count())
        sets = cut(map_batches(self.rows, _sets(self.k, wanted), "cls long, v binary").dropDuplicates(["cls"])).withColumn("n", F.expr("cast(octet_length(v) div 8 as int)"))
        return self._checked(close, sets, False)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (a, b) between classes, enough of them for the components and none within a component already
        known; and these components (node, comp)."""
        num, den = self.num, self.den
        made = lambda among: map_batches(self.rows, _index(self.k, self.frequent, num, den, among), "key long, cls long, n int, place int, lead int")
        several = cut(made(None).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
        n = several.count()
        if not n:
            none = self.docs.sparkSession.createDataFrame([], "a long, b long")
            return none, none.toDF("node", "comp")
        index = cut(made(bloom(several, "key", n)).groupBy("key", "cls").agg(*[F.min(c).alias(c) for c in ("n", "place", "lead")]))
        # place and n in front: the hub is the class whose key stands foremost, so the one with the fewest tokens of its own
        hubs = cut(index.groupBy("key").agg(F.min(F.struct("place", "n", "cls", "lead")).alias("hub"), F.count("*").alias("c")).where("c > 1"))
        index = cut(spread(index, hubs, ["key"], "c"))
        near = index.where(F.col("cls") != F.col("hub.cls")).where(_fits(_at(""), _at("hub."), num, den))
        stars = near.groupBy("cls", F.col("hub.cls").alias("b")).agg(F.count("*").alias("c")).groupBy("cls").agg(F.max_by("b", F.struct("c", "b")).alias("b")).select(F.col("cls").alias("a"), "b")
        found = self._linked(self._close(cut(stars)))
        comp = cut(components(found))
        told = index.select("key", "cls", "n", "place", "lead").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        left, close, names = self._open(cut(told)), [], ("cls", "n", "place", "lead", "comp")
        while not left.isEmpty():
            small = left.where(F.col("c") <= BUCKET)
            a, b = (small.select("key", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s in "ab")
            more = a.join(b, "key").where("a_cls < b_cls").drop("key")
            large = cut(left.where(F.col("c") > BUCKET))
            if not large.isEmpty():
                part = F.pmod(F.xxhash64("cls"), F.lit(HUBS)).alias("part")
                heads = large.groupBy("key", "c", part).agg(F.min(F.struct(*names)).alias("h")).groupBy("key", "c").agg(F.collect_list("h").alias("heads"))
                heads = cut(heads)
                each = spread(large.drop("c"), heads, ["key"], "c", by=["cls"]).withColumn("h", F.explode("heads"))
                more = more.unionByName(each.select(*[F.col(c).alias(f"a_{c}") for c in names], *[F.col(f"h.{c}").alias(f"b_{c}") for c in names]).where("a_cls <> b_cls"))
                large = large.join(heads.select("key", F.explode("heads.cls").alias("cls")), ["key", "cls"], "left_anti")
            more = more.where("a_comp <> b_comp").where(_fits(_at("a_"), _at("b_"), num, den))
            pairs = cut(more.select(F.least("a_cls", "b_cls").alias("a"), F.greatest("a_cls", "b_cls").alias("b")).distinct())
            if not pairs.isEmpty():
                close.append(self._close(pairs))
            left = self._open(cut(large.drop("c")))
        if close and not (close := cut(functools.reduce(DataFrame.unionByName, close).distinct())).isEmpty():
            found = found.unionByName(self._linked(close))
            comp = cut(components(found))
        return found, comp

    def _open(self, told: DataFrame) -> DataFrame:
        """told(key, cls, n, place, lead, comp) with c, the bucket's size: of the buckets whose classes are in several components."""
        several = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")
        return cut(spread(told, cut(several), ["key"], "c", by=["cls"]))

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row."""
        _, comp = self.links()
        size = self.docs.where("n > 0").groupBy("cls").agg(F.count("*").alias("held"), F.min("doc_id").alias("least"))
        told = size.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        told = cut(told)
        least = cut(told.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
        by_class = cut(spread(told, least, ["comp"], "classes").select("cls", "held", "component_id"))
        own = spread(self.docs.select("doc_id", "n", "cls"), by_class, ["cls"], "held", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return own.select(F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(_LAST)).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose component has a smaller id; all columns pass through."""
    found = Join(docs, k, num, den).result()
    (name,) = free_names(docs, "gone")
    gone = cut(found.where("doc_id <> component_id or component_id is not null and doc_id is null").select(F.coalesce("doc_id", F.lit(_LAST)).alias(name)).distinct())
    sent = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    return docs.join(sent, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(name), "left_anti")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return Join(table(spark, folder, "documents").select("doc_id", "text"), 4, 85, 100).result()
