"""Each stage of the pipeline against a plain version on what the stage before it kept."""

import random
import string

import pytest

import corpus_pipeline
from tidewright.llm import packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of the seven old harbours on the northern coast keeps its lamp lit through the whole winter"


def corpus(rng):
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    good = lambda n: " ".join(rng.choices(vocab, k=n))
    texts = [good(rng.randrange(40, 120)) + "." for _ in range(60)]
    texts += ["## !! $$ " * 30 + good(3) for _ in range(60)]  # labelled poor, as every second row of them
    texts += [texts[i] for i in (0, 0, 3)] + [texts[1].upper()]
    for i in (5, 6, 7):
        w = texts[i].split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [f"{good(30)} {ITEM.upper()} {good(30)}", f"{good(30)} {ITEM.replace('old', 'odd')} {good(20)}", None, "", good(9000)]
    return [(10 + i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]


def shingles(text, k=5):
    w = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("tables")), corpus(random.Random(9))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(i < 60), 0) for i, (d, *_) in enumerate(rows[:120]) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "packing"]


def test_stages_against_plain_versions(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs = read("documents")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        docs = spark.createDataFrame(stages[name](spark, docs, folder).collect(), SCHEMA)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == read("documents").columns and docs.count() == len(kept[name])
    every = {r.doc_id: r.text for r in read("documents").collect()}

    model = quality.train(read("documents"), read("labels"))
    assert kept["quality"] == {d: t for d, t in every.items() if model.score(t) >= quality.THRESHOLD}
    assert set(range(10, 70)) <= set(kept["quality"]) and not set(range(70, 130)) & set(kept["quality"])

    last = {}
    for d, t in kept["quality"].items():
        k = (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        last[k] = max(d, last.get(k, d))
    assert set(kept["exact_dedup"]) == set(last.values())

    sets, least = {d: shingles(t) for d, t in kept["exact_dedup"].items()}, {d: d for d in kept["exact_dedup"]}
    for _ in sets:  # as often as a path can be long
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
        if all(least[least[d]] == least[d] for d in least):
            break
    assert set(kept["near_dedup"]) == set(least.values()) and len(kept["near_dedup"]) < len(kept["exact_dedup"])

    def nearest(text):
        """The least word edit distance of the item to a passage of the text."""
        item, blank = ITEM.split(), str.maketrans(dict.fromkeys(string.punctuation, " "))
        words = (text or "").lower().translate(blank).split()
        row = [0] * (len(words) + 1)
        for i, w in enumerate(item):
            new = [i + 1]
            for j, x in enumerate(words):
                new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    assert set(kept["decontaminate"]) == {d for d, t in kept["near_dedup"].items() if nearest(t) > len(ITEM.split()) // 6}
    assert len(kept["decontaminate"]) <= len(kept["near_dedup"]) - 2


def test_run(spark, folder):
    from tokenizers import Tokenizer

    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    own, size = Tokenizer.from_file(packing.default_tokenizer()), {}
    for r in docs.collect():
        size[r.doc_id] = len(own.encode(r.text or "", add_special_tokens=False).ids) + 1
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(size)
    for d, n in size.items():
        assert sorted(by_doc[d]) == [(i, i * 2048, min(2048, n - i * 2048)) for i in range(-(-n // 2048))]
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_odd_rows_whole(spark, folder):
    """Empty tables pass through all stages, and null ids and texts harm none."""
    rows = [(None, None, None, None, None), (None, "a few words of text", None, None, 1), (3, None, "xx", None, None), (3, "", None, None, 0)]
    for docs in (spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder).collect()
            assert len(out) <= docs.count() or name == "packing"
