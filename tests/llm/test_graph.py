import random

import numpy as np

from tidewright.llm import common, graph


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


def graphs():
    rng = random.Random(1)
    yield [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    yield [(i + 1, i) for i in range(70)] + [(200 + i, 201 + i) for i in range(9)]  # paths
    yield [(500, i) for i in range(40)] + [(-7, 600), (600, 601), (601, 3)]  # a star
    yield [(5, 5)]


def test_components(spark, monkeypatch):
    for edges in graphs():
        want = plain(edges)
        u, v = (np.array(x, dtype=np.int64) for x in zip(*edges, strict=True))
        assert dict(zip(*(x.tolist() for x in graph.least_reached(u, v)), strict=True)) == want
        df = spark.createDataFrame(edges, "a long, b long")
        linked = {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}
        for most, hot in ((10**6, 1000), (0, 1000), (0, 3)):  # in one task; in rounds; in rounds with salts
            monkeypatch.setattr(graph, "ONE_TASK", most)
            monkeypatch.setattr(graph, "HOT_ROWS", hot)
            monkeypatch.setattr(common, "HOT_ROWS", hot)
            assert {r.node: r.comp for r in graph.components(df).collect()} == linked
