"""Quality classifier: naive Bayes support vectors.

Every text becomes a set of hashed n-gram indicators: words and word pairs, runs of character shapes of length 3 to 5
(letters, capitals, digits, spaces and signs, equal neighbours collapsed), and how often words repeat. Indicators are
scaled by the log ratio of the smoothed class counts, a linear hinge-loss model is fitted on the scaled and normed
indicators by dual coordinate descent, and its margin is mapped to a probability by a logistic curve fitted on rows that
the descent did not see.

The model is fitted on a bounded sample of labelled rows: the `max_rows` whose ids have the smallest hashes. Its size is
fixed (2^BITS weights), so it may be sent to every task. Whole texts are scored.

Defined results: a null text scores as an empty one, by the intercept alone; an empty table gives an empty result; without
labels of both classes every score is 1 (or 0 if only label 0 occurs); repeated labels of an id count once, as the lowest, and of rows with one id one is learned from, that with the least indicators;
other columns pass through `score`, whatever their names, but the name given for the score must be free.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import map_batches, remainder, word_hashes, words
from tidewright.sources import table

NAME = "op1_quality"
BITS = 18
MAX_ROWS = 8000
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape_classes() -> np.ndarray:
    """A class below 32 for each byte: letters 1, capitals 2, digits 3, blanks 4, line ends 5, other signs by value."""
    out = np.array([8 + b % 24 for b in range(256)], dtype=np.uint64)
    out[128:] = 1
    for lo, hi, k in ((97, 122, 1), (65, 90, 2), (48, 57, 3)):
        out[lo : hi + 1] = k
    out[[32, 9]] = 4
    out[[10, 13]] = 5
    return out


_CLASS = _shape_classes()


def indicators(text: str | None) -> np.ndarray:
    """The sorted distinct feature numbers of a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    h = word_hashes(words(text))
    if not len(h):
        return np.zeros(0, dtype=np.int32)
    with np.errstate(over="ignore"):
        down = np.uint64(64 - BITS)
        parts = [h >> down, (h[:-1] * _MIX + h[1:]) * _MIX >> down]
        c = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
        c = c[np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))]
        for n in (3, 4, 5):
            if len(c) >= n:
                code = np.full(len(c) - n + 1, np.uint64(n), dtype=np.uint64)
                for i in range(n):
                    code = code * np.uint64(32) + c[i : len(c) - n + 1 + i]
                seen = np.zeros(8 << 5 * n, dtype=bool) if n == 3 else None
                if seen is not None:
                    seen[code] = True
                    code = np.flatnonzero(seen).astype(np.uint64)
                parts.append((code + np.uint64(7)) * _MIX >> down)
        same = int(10 * np.count_nonzero(h[1:] == h[:-1]) / len(h))
        fresh = int(10 * len(np.unique(h)) / len(h))
        pairs = int(10 * len(np.unique(parts[1])) / max(1, len(h) - 1))
        own = [1000 + same, 2000 + fresh, 3000 + pairs, 4000 + int(np.log2(len(h)))]
        parts.append(np.array(own, dtype=np.uint64) * _MIX >> down)
    return np.unique(np.concatenate(parts)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators, times the scale
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        r = self.scale[x]
        return float(self.weights[x].sum() / (np.sqrt(np.dot(r, r)) + 1e-9)) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def descend(rows: list[np.ndarray], r: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 8, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2/2 + C sum max(0, 1 - y w x), x normed; the bias is a constant feature."""
    w, b, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    values = [(v / (np.sqrt(np.dot(v, v)) + 1e-9)) for v in (r[x] for x in rows)]
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, v = rows[i], values[i]
            g = y[i] * (np.dot(w[x], v) + b) - 1
            a = min(max(alpha[i] - g / 2.0, 0.0), cost)  # |x|^2 with the constant feature is 2
            if d := (a - alpha[i]) * y[i]:
                w[x] += d * v
                b += d
                alpha[i] = a
                moved += abs(d)
        if moved < 1e-4 * len(rows):
            break
    return w, b


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: indicators; labels: 0 or 1."""
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        sure = 30.0 if not len(labels) or labels[0] == 1 else -30.0
        return Model(np.zeros(size), np.ones(size), 0.0, 0.0, sure)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held = np.zeros(len(rows), dtype=bool)
    used = [i for i in range(len(rows)) if not held[i]]
    counts = np.ones((2, size))
    for i in used:
        counts[labels[i], rows[i]] += 1
    totals = np.bincount(labels[used], minlength=2) + 2.0
    r = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    w, b = descend([rows[i] for i in used], r, np.where(labels[used] == 1, 1.0, -1.0))
    w = 0.75 * w + 0.25 * np.abs(w).mean()  # interpolated towards plain naive Bayes
    model = Model((w * r), r, b, 1.0, 0.0)
    seen = np.flatnonzero(held) if held.any() else np.array(used)
    m, t = np.array([model.margin(rows[i]) for i in seen]), labels[seen].astype(float)
    a, c = 2.0, 0.0
    for _ in range(50):  # Newton's method, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g = np.array([np.dot(p - t, m) + 1e-2 * a, (p - t).sum()])
        q = p * (1 - p) + 1e-6
        hess = np.array([[np.dot(q, m * m) + 1e-2, np.dot(q, m)], [np.dot(q, m), q.sum()]])
        step = np.linalg.solve(hess, g)
        a, c = a - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    return Model(model.weights.astype(np.float32), r.astype(np.float32), b, float(a), float(c))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs(doc_id, text); labels(doc_id, quality): the rows to learn from. At most max_rows ids are sent to the tasks and as many rows of indicators to the driver."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_label")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "label": b.column(2), "x": pa.array([indicators(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())})

    one = map_batches(rows, featurise, "doc_id long, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.label", "r.x")
    got = one.toArrow().sort_by("doc_id").to_pydict()
    return fit([np.frombuffer(x, dtype=np.int32) for x in got["x"]], np.array(got["label"], dtype=np.int64))


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """docs with the column `name`, from 0 to 1; all other columns pass through."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, name])

    return map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(remainder("doc_id", 4) != 2)
    scored = score(docs, train(docs.where(remainder("doc_id", 4) != 2), labels))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
