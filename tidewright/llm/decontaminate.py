"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words is looked for with up to e = m // WORDS_PER_ERROR edited words. It is cut into e + 1 pieces: a
passage within e edits holds one of them unchanged. Pieces are found in the whole normalised text by one Aho-Corasick
pass; around each hit the word-level edit distance is verified by Myers' bit-parallel algorithm, with the item free to
begin and end anywhere in the window.

Texts and items are compared as lower-cased words, ASCII punctuation and white space being separators. Items are sent to
the tasks in blocks of BLOCK_ITEMS rows and BLOCK_CHARS characters at most, one pass over the documents for each block, so
that what is sent has a fixed bound however many items there are.

Items of fewer than WORDS_PER_ERROR words have no error budget: they are one piece, and found where their words stand. Those
of a word or two stand in ordinary prose; who doesn't want that gives `min_words`.

Defined results: null and empty texts match nothing; items without words, or with fewer than `min_words` (1 by default), are
not looked for; repeated rows are reported each; an item that occurs several times in a text is reported once, at its best
place; other columns, whatever their names, pass through `drop_matching`.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import map_batches
from tidewright.sources import table

NAME = "op9_decontaminate"
WORDS_PER_ERROR = 6
BLOCK_ITEMS = 5000
BLOCK_CHARS = 4_000_000
_BLANK = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))


def normal(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


def budget(m: int) -> int:
    return m // WORDS_PER_ERROR


def pieces(words: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """(place, words) of e + 1 pieces of nearly equal length."""
    n = budget(len(words)) + 1
    cuts = [i * len(words) // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text, and where that ends (words up to there)."""
    m = len(pattern)
    peq: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph) & full) & full, ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """items: (id, text). The automaton is built where it is first used."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 1):
        self.items = [(i, w) for i, t in items if len(w := normal(t)) >= max(1, min_words)]
        self.automaton = None

    def __getstate__(self):
        return self.items

    def __setstate__(self, items):
        self.items, self.automaton = items, None

    def _build(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, (_, w) in enumerate(self.items):
            for at, p in pieces(w):
                key = f" {b' '.join(p).decode('latin-1')} "
                self.automaton.add_word(key, (len(p), [*self.automaton.get(key, (0, []))[1], (k, at)]))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, place in words), one for each item found."""
        if not self.items or not text:
            return []
        if self.automaton is None:
            self._build()
        found = normal(text)
        flat = f" {b' '.join(found).decode('latin-1')} "
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, set[int]] = {}
        seen = passed = 0  # words before the place in flat that is counted up to
        for end, (size, owners) in self.automaton.iter(flat):
            passed += flat.count(" ", seen, end)
            seen = end
            place = passed - size
            for k, at in owners:
                item, e = self.items[k][1], budget(len(self.items[k][1]))
                start = place - at
                if start in tried.setdefault(k, set()) or best.get(k, (e + 1,))[0] == 0:
                    continue
                tried[k].add(start)
                lo = max(0, start - e)
                d, to = myers(item, found[lo : start + len(item) + e])
                if d <= e and (k not in best or (d, lo + to) < best[k]):
                    best[k] = d, lo + to
        return sorted((self.items[k][0], d, max(0, to - len(self.items[k][1]))) for k, (d, to) in best.items())


def matchers(items: DataFrame, min_words: int = 1, key: str = "item_id", text: str = "text") -> Iterator[Matcher]:
    """One for each block of items. Only one block is held at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), text).orderBy(key, text).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r[1]) > BLOCK_CHARS):
            yield Matcher(block, min_words)
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield Matcher(block, min_words)


def matches(docs: DataFrame, items: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, place) for each item that a document holds."""
    schema = "doc_id long, item_id long, distance int, place int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out: DataFrame | None = None
    for m in matchers(items, min_words):

        def run(batches: Iterator[pa.RecordBatch], m: Matcher = m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in m.find(t)]
                cols = list(zip(*got, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "distance", "place"])

        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_matching(docs: DataFrame, items: DataFrame, min_words: int = 1) -> DataFrame:
    """docs without the rows that hold an item; all columns pass through. Rows are judged where they are, without a shuffle."""
    at = docs.columns.index("text")
    for m in matchers(items, min_words):

        def run(batches: Iterator[pa.RecordBatch], m: Matcher = m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not m.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of documents and benchmark items that they hold."""
    return matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
