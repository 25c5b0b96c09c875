"""Components by one task and by rounds of joins."""

import numpy as np

from weir.llm import graph


def test_components_by_one_task_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, 7), (-5, 900), (900, 3)] + [tuple(map(int, p)) for p in rng.integers(1_000, 1_200, (120, 2))]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = {}
    for a, b in pairs:
        one, two = want.get(a, {a}), want.get(b, {b})
        for n in (both := one | two):
            want[n] = both
    want = {n: min(s) for n, s in want.items()}
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, name, cut=graph.cut: cuts.append(name) or cut(df, name))
    assert {r.node: r.component for r in graph.components(edges).collect()} == want
    assert cuts == ["edges", "labels"]  # one round, whatever the length of a chain
    monkeypatch.setattr(graph, "SMALL", 10)
    rows = graph.components(edges).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert graph.components(edges.limit(0)).collect() == []
