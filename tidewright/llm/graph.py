"""Connected components and Bloom filters over keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import HOT_ROWS, spread
from tidewright.session import cut

MAX_BITS = 1 << 27
ONE_TASK = 1_000_000


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and the smallest that each reaches: labels fall to a neighbour's until none does."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        for at in (a, b, label[a], label[b]):  # the nodes, and the ones that stand for them
            np.minimum.at(now, at, low)
        while not np.array_equal(now, short := now[now]):
            now = short
        if np.array_equal(now, label):
            return nodes, nodes[label]
        label = now


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, comp = least_reached(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[i : i + 100_000]), "comp": pa.array(comp[i : i + 100_000])})


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges(a, b), of type long: the smallest node that each reaches. Alternates the large-star and
    small-star steps (Kiveris et al., 2014) until no edge changes; joins at nodes with many edges are salted. Up to ONE_TASK
    edges, which are counted first, are solved in one executor's task instead, with the same result and without rounds."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return e.coalesce(1).mapInArrow(_solve, "node long, comp long")

    def star(pairs: DataFrame, large: bool, hot: bool) -> DataFrame:
        """pairs: (u, v), v a neighbour of u. Links neighbours to the least of them and u. hot: some u has many."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met")).select("u", F.least("u", "m").alias("m"), "met")
        j = spread(pairs, cut(least), ["u"], "met") if hot else pairs.join(least, "u")
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(x: DataFrame) -> tuple:
        """What changes with an edge, and the most edges of a node."""
        ends = x.select("u", "v").unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"))
        return tuple(met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum(F.col("s") * (F.col("u") % 1009)), F.coalesce(F.max("n"), F.lit(0))).first())

    before = state(e)
    while before[0]:
        hot = before[2] > HOT_ROWS
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, True, hot)
        e = cut(star(cut(large) if hot else large, False, hot))
        if (now := state(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def bloom(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A Bloom filter of n hashes of type long, as 64-bit words. Of MAX_BITS at most (16 MB), however many keys there are: it only spares a shuffle."""
    bits = 1 << min(MAX_BITS.bit_length() - 1, max(16, (16 * max(n, 1) - 1).bit_length()))
    k = F.col(column)
    at = F.explode(F.array(k.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(bits - 1))))
    rows = keys.select(at.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(i & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows["w"].to_numpy()] = rows["x"].to_numpy().view(np.uint64)
    return out


def maybe_in(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """keys: uint64."""
    mask, one = np.uint64(64 * len(filter_) - 1), np.uint64(1)
    a, b = keys & mask, (keys >> np.uint64(32)) & mask
    hit = lambda x: (filter_[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & one
    return (hit(a) & hit(b)).astype(bool)
