"""Scoring by a gated recurrent language model, in numpy.

Tokens are words and an end. Counts of all training words come from a distributed aggregation. The VOCAB most frequent
words have a recurrent model: embeddings, one layer of gated recurrent units, and an output softmax factored into classes
of words of like frequency. All other words are one `unknown` token there, times their smoothed share of the words outside
the vocabulary, so that the score is the log probability of the complete text.

Training: truncated backpropagation through windows of WINDOW tokens, the state being carried from one window to the next.
All training documents are dealt to ROUNDS rounds; each is learned from once, whole. In a round, tasks start from the same
weights, learn from the documents they read, in shards of about SHARD_TOKENS tokens, and are averaged in a tree. LANES of a
shard are read side by side; a lane reads document after document, with the state cleared between them.

Scoring: a task holds up to BUFFER tokens of ids, spread over LANES; each lane reads document after document, carries the
state through all windows of one and clears it at the next. Counts of the HEAD most frequent words are sent to the tasks
(a fixed bound); rarer words are joined with their counts, and summed by document with partial aggregation.

Defined results: null and empty texts are the end token alone; without training rows all counts are 0; repeated rows are
scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import gathered, map_batches, remainder, split_words
from tidewright.session import cut
from tidewright.sources import table

NAME = "op4_language_model"
CLASSES = CLASS_SIZE = 64
VOCAB = CLASSES * CLASS_SIZE  # with the end (0) and the unknown word (1)
HIDDEN = 16
HEAD = 400_000
LANES = 256  # read side by side; fewer, but MIN_LANES at least, where a shard would else give fewer than UPDATES steps
MIN_LANES, UPDATES = 16, 350
WINDOW, SCORED = 16, 64  # steps at a time in training (what gradients reach back) and in scoring
BUFFER = SHARD_TOKENS = 3_000_000
COUNTED = 4_000_000  # words held while they are counted
ROUNDS = 2
RATE = 0.02
FAN_IN = 16
END, UNKNOWN = 0, 1
SAFE = 60.0

Params = dict[str, np.ndarray]


def shapes() -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {"emb": (VOCAB, 3 * h), "rec": (h, 2 * h), "cand": (h, h), "cls_w": (h, CLASSES), "cls_b": (CLASSES,), "word_w": (CLASSES, h, CLASS_SIZE), "word_b": (CLASSES, CLASS_SIZE)}


def pack(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in shapes()]).astype(np.float32).tobytes()


def unpack(data: bytes) -> Params:
    return views(np.frombuffer(data, dtype=np.float32).copy())


def views(flat: np.ndarray) -> Params:
    """The parts of one vector that holds all parameters."""
    out, at = {}, 0
    for k, s in shapes().items():
        out[k] = flat[at : at + math.prod(s)].reshape(s)
        at += math.prod(s)
    return out


def initial(counts: np.ndarray, seed: int = 1) -> Params:
    """Small random weights; biases that give the smoothed unigram of counts (by id; negative: no such word)."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.1 if k == "emb" else 1 / math.sqrt(HIDDEN) * (0.1 if "_w" in k else 1.0))).astype(np.float32) for k, s in shapes().items()}
    share = np.where(counts >= 0, counts + 1.0, 1e-12).reshape(CLASSES, CLASS_SIZE)
    by_class = share.sum(1)
    p["cls_b"] = np.log(by_class / by_class.sum()).astype(np.float32)
    p["word_b"] = np.log(share / by_class[:, None]).astype(np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def step(p: Params, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """A step of all lanes: the new state, and what its derivative needs."""
    e = p["emb"][ids]
    n = HIDDEN
    g = _sigmoid(e[:, : 2 * n] + h @ p["rec"])
    z, r = g[:, :n], g[:, n:]
    rh = r * h
    c = np.tanh(e[:, 2 * n :] + rh @ p["cand"])
    return h + z * (c - h), z, r, c, rh


def _ceilings(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What no logit h @ w + b of a softmax exceeds, as states are within -1 and 1."""
    return (np.abs(w).sum(-2) + b).max(-1)


def _log_softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray, top: float, k: np.ndarray, own: np.ndarray, grads: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of own; with grads also the derivative of their negated sum by the logits. top: a bound of the logits."""
    a = h @ w
    a += b - top
    if top > SAFE:  # so far above that all may vanish
        a -= a.max(1, keepdims=True)
    out = a[k, own]
    ex = np.exp(a, out=a)
    total = ex.sum(1)
    out -= np.log(total)
    if grads:
        ex /= total[:, None]
        ex[k, own] -= 1
    return out, ex


def output(p: Params, h: np.ndarray, target: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probabilities of target given states h; with grads: adds those of their negated sum, and returns that of h."""
    cls, slot = target // CLASS_SIZE, target % CLASS_SIZE
    rows = np.arange(len(target))
    told = grads is not None
    logp, d = _log_softmax(h, p["cls_w"], p["cls_b"], float(_ceilings(p["cls_w"], p["cls_b"])), rows, cls, told)
    dh = None
    if told:
        grads["cls_w"] += h.T @ d
        grads["cls_b"] += d.sum(0)
        dh = d @ p["cls_w"].T
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    hs, slots = h[order], slot[order]
    inner, dhs = np.empty_like(logp), np.empty_like(hs)
    tops = _ceilings(p["word_w"], p["word_b"]).tolist()
    for c in range(CLASSES):
        lo, hi = bounds[c], bounds[c + 1]
        if lo == hi:
            continue
        hc, w = hs[lo:hi], p["word_w"][c]
        inner[lo:hi], d = _log_softmax(hc, w, p["word_b"][c], tops[c], rows[: hi - lo], slots[lo:hi], told)
        if told:
            grads["word_w"][c] += hc.T @ d
            grads["word_b"][c] += d.sum(0)
            dhs[lo:hi] = d @ w.T
    logp[order] += inner
    if told:
        dh[order] += dhs
    return logp, dh


def lanes(docs: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Deals documents to n lanes of nearly equal length: arrays of document numbers."""
    import heapq

    heap = [(0, i) for i in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (size + len(docs[d]), i))
    return [np.array(x, dtype=np.int64) for x in out if x]


def _streams(docs: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lanes, longest first: token ids (time, lane; -1 after the end), document numbers, lengths."""
    dealt = [(np.concatenate([docs[d] for d in x]), np.concatenate([np.full(len(docs[d]), d, dtype=np.int32) for d in x])) for x in lanes(docs, n)]
    dealt.sort(key=lambda x: -len(x[0]))
    size = np.array([len(x) for x, _ in dealt])
    ids, own = np.full((size[0], len(dealt)), -1, dtype=np.int32), np.full((size[0], len(dealt)), -1, dtype=np.int32)
    for i, (x, d) in enumerate(dealt):
        ids[: len(x), i], own[: len(x), i] = x, d
    return ids, own, size


def score(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document: arrays of ids that end with END."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    ids, own, size = _streams(docs, LANES)
    h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
    last = np.full(ids.shape[1], END, dtype=np.int32)
    for t0 in range(0, len(ids), SCORED):
        states, targets, owners = [], [], []
        for t in range(t0, min(t0 + SCORED, len(ids))):
            n = int(np.searchsorted(-size, -t, side="left"))  # lanes that still read
            h, last = h[:n], last[:n]
            h = np.where((last == END)[:, None], np.float32(0), h)  # a document begins; the states kept stay as they are
            h = step(p, last, h)[0]
            states.append(h)
            last = ids[t, :n]
            targets.append(last)
            owners.append(own[t, :n])
        logp, _ = output(p, np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), weights=logp, minlength=len(docs))
    return out


class Trainer:
    """Truncated backpropagation by Adam, from the weights p on; `fit` may be called for one shard after another."""

    def __init__(self, p: Params, rate: float = RATE):
        self.flat = np.concatenate([p[k].ravel() for k in shapes()])
        self.grad, self.m, self.v, self.scratch = (np.zeros_like(self.flat) for _ in range(4))
        self.p, self.g = views(self.flat), views(self.grad)
        self.rate, self.steps = rate, 0

    def fit(self, docs: list[np.ndarray]) -> Params:
        """One pass over docs, whole and in order within a lane; the state is carried from window to window until a document ends."""
        tokens = sum(map(len, docs))
        if not tokens:
            return self.p
        n = min(LANES, max(MIN_LANES, tokens // (WINDOW * UPDATES)))
        ids, _, size = _streams(docs, n)
        state = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32)
        last = np.full(ids.shape[1], END, dtype=np.int32)
        full = ids.shape[1] * WINDOW
        for t0 in range(0, len(ids), WINDOW):
            state, last = self._window(ids[t0 : t0 + WINDOW], size - t0, state, last, full)
        return self.p

    def _window(self, ids: np.ndarray, left: np.ndarray, state: np.ndarray, last: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray]:
        """Lanes are ordered by what is left of them: those that end within the window leave it at the back."""
        p, g = self.p, self.g
        kept, states = [], []
        h = state
        for t in range(len(ids)):
            n = int(np.searchsorted(-left, -t, side="left"))
            if not n:
                break
            h, last = h[:n], last[:n]
            h = np.where((last == END)[:, None], np.float32(0), h)
            to, z, r, c, rh = step(p, last, h)
            kept.append((last, h, z, r, c, rh))
            states.append(to)
            h, last = to, ids[t, :n]
        targets = np.concatenate([ids[t, : len(k[0])] for t, k in enumerate(kept)])
        _, dout = output(p, np.concatenate(states), targets, g)
        stops = np.cumsum([len(k[0]) for k in kept]).tolist()
        h0, z, r, c, rh = (np.concatenate([k[i] for k in kept]) for i in range(1, 6))
        by_cand, by_z, by_r, by_h = z * (1 - c * c), (c - h0) * z * (1 - z), h0 * r * (1 - r), 1 - z
        both = np.empty((len(h0), 3 * HIDDEN), dtype=np.float32)  # derivatives by the gates and by the candidate
        dh = np.zeros((0, HIDDEN), dtype=np.float32)
        rec, cand = np.ascontiguousarray(p["rec"].T), np.ascontiguousarray(p["cand"].T)
        for k in range(len(kept) - 1, -1, -1):
            at = slice(stops[k] - len(kept[k][0]), stops[k])
            d, dg, dc = dout[at], both[at, : 2 * HIDDEN], both[at, 2 * HIDDEN :]
            d[: len(dh)] += dh
            np.multiply(d, by_cand[at], out=dc)
            drh = dc @ cand
            np.multiply(d, by_z[at], out=dg[:, :HIDDEN])
            np.multiply(drh, by_r[at], out=dg[:, HIDDEN:])
            dh = d * by_h[at]
            drh *= r[at]
            dh += drh
            dh += dg @ rec
            dh[kept[k][0] == END] = 0
        g["cand"] += rh.T @ both[:, 2 * HIDDEN :]
        g["rec"] += h0.T @ both[:, : 2 * HIDDEN]
        read = np.concatenate([k[0] for k in kept])
        order = np.argsort(read.astype(np.uint16), kind="stable")
        found = read[order]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        g["emb"][found[first]] += np.add.reduceat(both[order], first, axis=0)
        self._update(full)
        return h, last

    def _update(self, full: int) -> None:
        """Adam, in place. The loss is the mean over a full window, so that what few lanes still read weighs as little as it is."""
        flat, grad, m, v, scratch = self.flat, self.grad, self.m, self.v, self.scratch
        self.steps += 1
        grad /= full
        m *= 0.9
        m += np.multiply(grad, 0.1, out=scratch)
        v *= 0.99
        v += np.multiply(np.multiply(grad, grad, out=scratch), 0.01, out=scratch)
        np.sqrt(np.divide(v, 1 - 0.99**self.steps, out=scratch), out=scratch)
        scratch += 1e-6
        flat -= np.multiply(np.divide(m, scratch, out=scratch), self.rate / (1 - 0.9**self.steps), out=scratch)
        grad[:] = 0


def train(p: Params, docs: list[np.ndarray], rate: float = RATE) -> Params:
    """One pass of truncated backpropagation over docs."""
    return Trainer(p, rate).fit(docs)


class Vocabulary:
    """What all tasks know of words: `counts` by falling frequency, of which the first VOCAB - 2 have ids."""

    def __init__(self, counts: dict[str, int]):
        self.words = pa.array(list(counts), pa.string())
        n = min(len(counts), VOCAB - 2)
        #: By place in counts, and for the words that aren't there.
        self.ids = np.full(len(counts) + 1, UNKNOWN, dtype=np.int32)
        self.ids[:n] = np.arange(2, n + 2)
        self.logs = np.array([*(math.log10(c + 1.0) for c in counts.values()), 0.0])

    def places(self, found: pa.Array, known: int | None = None) -> np.ndarray:
        """The place of each word in counts, of which the first `known` count; that after the last for other words."""
        at = pc.index_in(found, value_set=self.words if known is None else self.words.slice(0, known))
        return pc.fill_null(at, len(self.words)).to_numpy()

    def documents(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text, with its end."""
        found, sizes = split_words(column)
        return with_ends(self.ids[self.places(found, VOCAB - 2)], sizes)


def with_ends(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of texts of these sizes, each followed by END."""
    stops = np.cumsum(sizes)
    out = np.full(len(ids) + len(sizes), END, dtype=np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return np.split(out, stops + np.arange(1, len(sizes) + 1))[:-1]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of docs(doc_id, text), counted within tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            got = pa.chunked_array(held, pa.string()).value_counts()
            for i in range(0, len(got), 100_000):
                part = got.slice(i, 100_000)
                yield pa.RecordBatch.from_arrays([part.field("values"), part.field("counts")], names=["word", "c"])

        for b in batches:
            held.append(split_words(b.column(1))[0])
            size += len(held[-1])
            if size > COUNTED:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return map_batches(docs.select("doc_id", "text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def text_mark(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)


class Model:
    """Fitted on `docs` (doc_id, text); scores any documents."""

    def __init__(self, docs: DataFrame):
        counts = cut(word_counts(docs))
        self.rows = docs.count()  # each has an end
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.types = total[0] + self.rows, total[1] + (self.rows > 0)
        head = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
        self.head = dict(zip(head["word"].to_pylist(), head["c"].to_pylist(), strict=True))
        self.counts = counts
        self.words = Vocabulary(self.head)
        known = sum(list(self.head.values())[: VOCAB - 2])
        self.rest_tokens, self.rest_types = self.tokens - self.rows - known, max(0, self.types - (self.rows > 0) - min(len(self.head), VOCAB - 2))
        by_id = np.full(VOCAB, -1.0)
        by_id[END], by_id[UNKNOWN] = self.rows, self.rest_tokens
        by_id[2 : 2 + min(len(self.head), VOCAB - 2)] = list(self.head.values())[: VOCAB - 2]
        self.params = initial(by_id)
        for k in range(ROUNDS):
            self.params = self._trained(docs, k)

    def _trained(self, docs: DataFrame, k: int) -> Params:
        """The weights after round k. Tasks train the documents they read, shard after shard, without a shuffle of texts."""
        chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ROUNDS)) == k)
        start, known = pack(self.params), self.words

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, held, size, n = Trainer(unpack(start)), [], 0, 0
            for b in batches:
                held += known.documents(b.column(1))
                size = sum(map(len, held))
                if size >= SHARD_TOKENS:
                    model.fit(held)
                    held, n = [], n + size
            if held:
                model.fit(held)
                n += size
            if n:
                yield pa.RecordBatch.from_pydict({"p": pa.array([pack(model.p)], pa.binary()), "n": pa.array([float(n)])})

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0.0
            for b in batches:
                for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(x, dtype=np.float32).astype(np.float64) * w
                    total, n = (x if total is None else total + x), n + w
            if total is not None:
                yield pa.RecordBatch.from_pydict({"p": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n])})

        schema = "p binary, n double"
        now = cut(map_batches(chosen, fit, schema))  # else the tree's few tasks would train the shards
        parts = now.rdd.getNumPartitions()
        while parts > 1:  # a tree, whose root alone reaches the driver
            parts = math.ceil(parts / FAN_IN)
            now = cut(now.coalesce(parts).mapInArrow(average, schema))
        got = now.collect()
        if not got:
            return self.params
        n = sum(r.n for r in got)
        return unpack((sum(np.frombuffer(r.p, dtype=np.float32).astype(np.float64) * r.n for r in got) / n).astype(np.float32).tobytes())

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        known, params, ended = self.words, pack(self.params), self.rows
        end_log = math.log10(ended + 1.0)

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(doc_id, mark, word, times) of the words that `known` lacks."""
            for b in gathered(batches):
                found, sizes = split_words(b.column(1))
                away = known.places(found) == len(known.words)
                codes = found.filter(pa.array(away)).dictionary_encode()
                n = len(codes.dictionary) + 1
                pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[away] * n + codes.indices.to_numpy(), return_counts=True)
                row, word = pairs // n, pairs % n
                marks = np.array([text_mark(t) for t in b.column(1).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(marks[row]), codes.dictionary.take(pa.array(word)), pa.array(times.astype(np.int64))], names=["doc_id", "mark", "word", "times"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = unpack(params)
            held: list[pa.RecordBatch] = []
            texts: list[np.ndarray] = []
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                scores = score(p, texts) / math.log(10)
                at = 0
                for x in held:
                    yield x.append_column("rnn", pa.array(scores[at : at + x.num_rows]))
                    at += x.num_rows

            for b in gathered(batches):
                found, sizes = split_words(b.column(1))
                at = known.places(found)
                row = np.repeat(np.arange(len(sizes)), sizes)
                per_row = lambda w: np.bincount(row, weights=w, minlength=len(sizes)).astype(np.float64)
                ids, logs, there = known.ids[at], known.logs[at], at < len(known.words)
                texts += with_ends(ids, sizes)
                cols = {
                    "doc_id": b.column(0),
                    "mark": pa.array([text_mark(t) for t in b.column(1).to_pylist()], pa.int64()),
                    "n_tokens": pa.array(sizes + 1, pa.int64()),
                    "head_known": pa.array(per_row(there).astype(np.int64) + (ended > 0)),
                    "head_log": pa.array(per_row(logs) + end_log),
                    "unknown": pa.array(per_row(ids == UNKNOWN).astype(np.int64)),
                    "unknown_log": pa.array(per_row(np.where(ids == UNKNOWN, logs, 0.0))),
                }
                held.append(pa.RecordBatch.from_pydict(cols))
                size += int(sizes.sum())
                if size > BUFFER:
                    yield from out()
                    held, texts, size = [], [], 0
            if held:
                yield from out()

        told = map_batches(rows, run, "doc_id long, mark long, n_tokens long, head_known long, head_log double, unknown long, unknown_log double, rnn double")
        found = map_batches(rows, rare, "doc_id long, mark long, word string, times long").join(self.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        none = {"n_tokens": "long", "head_known": "long", "head_log": "double", "unknown": "long", "unknown_log": "double", "rnn": "double"}
        words_ = found.select("doc_id", "mark", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).alias("copies"), (F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0)).cast("long").alias("rare_known"))
        rows_ = told.withColumns({"copies": F.lit(1), "rare_log": F.lit(0.0), "rare_known": F.lit(0).cast("long")})
        # repeated rows of one id and text are one group, whose rare words count as often as it has rows
        one = rows_.unionByName(words_).groupBy("doc_id", "mark").agg(*[F.max(c).alias(c) for c in none], *[F.sum(c).alias(c) for c in ("copies", "rare_log", "rare_known")])
        one = one.withColumns({"rare_log": F.col("rare_log") / F.col("copies"), "rare_known": F.expr("rare_known div copies"), "copy": F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))})
        rest = math.log10(self.rest_tokens + self.rest_types + 1.0)
        return one.select(
            "doc_id",
            "n_tokens",
            (F.col("head_known") + F.col("rare_known")).alias("n_known"),
            F.lit(int(self.tokens)).cast("long").alias("train_tokens"),
            (F.col("head_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(math.log10(self.tokens + self.types + 1.0))).alias("base_score"),
            (F.col("rnn") + F.col("unknown_log") + F.col("rare_log") - F.col("unknown") * F.lit(rest)).alias("score"),
        )


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = Model(docs.where(remainder("doc_id", 7) != 2)).score(docs)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
