"""Language identification by cross-parsing entropy.

For each language a suffix automaton accepts every substring of its labelled words. A word, with its boundaries marked, is
parsed greedily into the longest phrases that the automaton accepts. The phrases of a text, times the logarithm of the
size of the language's labelled text, over its letters estimate the cross entropy with that language; the language that
needs fewest so normalised phrases wins, however much labelled text others have. Words are parsed one by one, so that the
parse of a word that repeats is kept (in a bounded memo), and a word that repeats in labelled text is accepted once.

The automata are fitted on a bounded sample: of each language the SAMPLE_DOCS distinct texts with the least hashes, or fewer
if they have over SAMPLE_CHARS characters together (one at least). Their whole texts are learned from. A first fit drops
texts that another language parses better (wrong labels, mixed texts), then the automata are built anew. Whole texts are
predicted.

Defined results: `und` with score 0 for null, empty and letterless texts, and for all where nothing was learned; ties go
to the first language in order; null and empty languages are not learned; rows without an id are learned from like others;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright.llm.common import map_batches, remainder
from tidewright.sources import table

NAME = "op8_langid"
SAMPLE_DOCS = 120
SAMPLE_CHARS = 1_500_000
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


class Automaton:
    """The suffix automaton of a text (Blumer et al.), with transitions only: longest matches need no more."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """The number of longest-match phrases that text parses into; a character that never occurs is one itself."""
        n, state, nexts = 1, 0, self.next
        for c in text:
            if (to := nexts[state].get(c)) is None:
                if state:
                    n += 1
                    to = nexts[0].get(c)
                if to is None:
                    n, to = n + 1, 0
            state = to
        return n if state else n - 1


def letters(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Model:
    """samples: for each language its distinct words, with a space around each, and the size of its labelled text. Automata
    are built where they are first used."""

    def __init__(self, samples: dict[str, tuple[str, int]]):
        self.samples = dict(sorted(samples.items()))
        self.factors = [math.log2(2 + n) for _, n in self.samples.values()]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.automata: list[Automaton] = []

    def __getstate__(self):
        return self.samples

    def __setstate__(self, samples):
        self.__init__(samples)

    def costs(self, word: str) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            if not self.automata:
                self.automata = [Automaton(t) for t, _ in self.samples.values()]
            marked = f" {word} "
            got = tuple(a.phrases(marked) for a in self.automata)
            if len(word) <= 40:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letters(text)
        if not found or not self.samples:
            return "und", 0.0
        n = len(self.samples)
        total = [0] * n
        for w, k in Counter(found).items():
            for i, c in enumerate(self.costs(w)):
                total[i] += k * c
        total = [t * f for t, f in zip(total, self.factors, strict=True)]
        best = min(range(n), key=total.__getitem__)
        weights = [(total[best] / t) ** 8 for t in total]
        return list(self.samples)[best], 1.0 / sum(weights)


def fit(texts: list[tuple[str, str]]) -> Model:
    """texts: (language, whole text)."""

    def build(rows: list[tuple[str, str]]) -> Model:
        by: dict[str, dict[str, None]] = {}
        sizes: Counter[str] = Counter()
        for lang, t in rows:
            found = letters(t)
            by.setdefault(lang, {}).update(dict.fromkeys(found))
            sizes[lang] += sum(map(len, found)) + len(found)
        return Model({k: (f" {' '.join(v)} ", sizes[k]) for k, v in by.items() if v})

    first = build(texts)
    # a text is parsed by automata that hold it, so its own language has an advantage: those that lose even so go
    kept = [(lang, t) for lang, t in texts if first.predict(t)[0] == lang]
    have = {lang for lang, _ in kept}
    return build(kept + [x for x in texts if x[0] not in have])


def train(docs: DataFrame) -> Model:
    """docs(text, lang). The counts of all languages, and the sample, reach the driver."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null and lang is not null and lang <> ''").withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Model({})
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * (SAMPLE_DOCS + 20) / max(1, n)))]), F.col("lang"))
    unit = F.pmod("h", F.lit(1_000_003)) / 1_000_003
    chosen = rows.where(unit < share).distinct()  # copies go within tasks; some twice SAMPLE_DOCS texts of each language are left
    first = Window.partitionBy("lang").orderBy("h", "text")
    ranked = chosen.withColumns({"k": F.row_number().over(first), "chars": F.sum(F.length("text").cast("long")).over(first.rowsBetween(Window.unboundedPreceding, 0))})
    got = ranked.where((F.col("k") <= SAMPLE_DOCS) & ((F.col("chars") <= SAMPLE_CHARS) | (F.col("k") == 1))).orderBy("lang", "k").select("lang", "text").collect()
    return fit([(r.lang, r.text) for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array([x for x, _ in out], pa.string()), "score": pa.array([s for _, s in out], pa.float64())})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs.where(remainder("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
