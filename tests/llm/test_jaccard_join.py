import random

import numpy as np

from tidewright.llm import jaccard_join as J
from tidewright.llm.common import shingles


def brute(rows, k, num, den):
    sets = [set(shingles(t, k).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=160):
    """Groups of near copies, texts around one long passage, chains of edits, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage = [word() for _ in range(40)]
    texts = ["", None, " \n", "a", "A", "a b", "a b c d", "a b c d e"]
    while len(texts) < n:
        own = [word() for _ in range(rng.randint(3, 60))]
        kind = rng.randrange(4)
        base = passage + own[:6] if kind == 0 else own + passage if kind == 1 else own
        texts.append(" ".join(base))
        now = list(base)
        for _ in range(rng.randrange(6) if kind else 2):
            if kind == 3:
                now = list(base)
            now[rng.randrange(len(now))] = word()
            texts.append(" ".join(now).upper() if rng.random() < 0.2 else " ".join(now))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark, monkeypatch):
    for seed, frequent, k, num in ((1, 5, 4, 85), (2, 3, 2, 70), (3, 2, 3, 80)):
        monkeypatch.setattr(J, "FREQUENT", frequent)
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as cls", "1 as key")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.Join(docs.repartition(3), k, num, 100).result().collect()}
        want = brute(rows, k, num, 100)
        assert got == want
        assert len({c for _, c in want.values()}) < len(rows) - 10


def test_keys_find_every_link_of_frequent_sets():
    rng = np.random.default_rng(5)
    for num, den in ((75, 100), (80, 100), (85, 100), (95, 100)):
        for _ in range(400):
            base = np.unique(rng.integers(0, 1 << 62, rng.integers(3, 120), dtype=np.uint64))
            frequent = np.sort(rng.choice(base, int(len(base) * rng.choice([0, 0.5, 0.9, 1])), replace=False))
            new = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
            x, y = (np.unique(np.concatenate((rng.choice(base, len(base) - rng.integers(0, 1 + len(base) // 8), replace=False), new(rng.integers(0, 1 + len(base) // 12))))) for _ in "xy")
            both = len(np.intersect1d(x, y))
            if den * both >= num * (len(x) + len(y) - both) and not np.array_equal(x, y):
                kx, px, lx = J.index_keys(x, frequent, num, den)
                ky, py, ly = J.index_keys(y, frequent, num, den)
                alpha = -(-num * (len(x) + len(y)) // (num + den))
                assert any(min(lx[i], ly[j], (lx[i] + ly[j]) // 3) + min(len(x) - px[i], len(y) - py[j]) >= alpha for i in range(len(kx)) for j in np.flatnonzero(ky == kx[i]))
            assert len(J.index_keys(x, frequent, num, den)[0]) <= len(x)


def test_large_buckets_are_taken_up_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 2)
    monkeypatch.setattr(J, "HUBS", 3)
    monkeypatch.setattr(J, "FREQUENT", 10_000)  # no token is frequent, so passages make buckets
    rows = corpus(7, 50)
    got = {r.doc_id: r.component_id for r in J.Join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100).result().collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 80, 100).items()}


def test_near_copies_of_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    rows = []
    for i in range(60):
        now = list(words)
        for _ in range(i * 10):
            now[rng.randrange(len(now))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(now)))
    rows.append((100, " ".join(words[:25_000])))
    got = {r.doc_id: r.component_id for r in J.Join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80, 100).result().collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100}


def test_keep_one_repeated_null_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (None, long), (7, None), (8, ""), (9, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as comp", "3 as gone", "4 as _gone", "5 as cls")
    left = J.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 3, 7, 8, 9]
    assert J.keep_one(docs.limit(0)).count() == 0


def test_sketch_bounds_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 5, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))))
        assert J.at_most(J.sketch(a), J.sketch(b)) >= len(np.intersect1d(a, b))
