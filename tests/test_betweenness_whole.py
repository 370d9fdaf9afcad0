"""Betweenness takes every node as a source, however many there are, some at a time."""

import random
from collections import deque

from knotwork.operators import graph


def test_betweenness_is_exact_beyond_800_nodes(spark, monkeypatch):
    r = random.Random(5)
    pairs = {("a", f"n{i:03}") for i in range(0, 840, 2)} | {("b", f"n{i:03}") for i in range(0, 840, 3)} | {(f"n{i:03}", f"n{r.randrange(840):03}") for i in range(840)}
    pairs = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    near = {}
    for x, y in sorted(pairs):
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    n, want = len(near), dict.fromkeys(near, 0.0)
    for s in near:
        far, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            order.append(v := queue.popleft())
            for w in near[v]:
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            want[w] += share[w] / ((n - 1) * (n - 2))
    assert n > 800
    monkeypatch.setattr(graph, "ROUND", n * 300, raising=False)
    kept, cut = graph.checkpointed, []
    monkeypatch.setattr(graph, "checkpointed", lambda df: (out := kept(df), cut.append(out))[0])
    got = {x.node: x.betweenness for x in graph.betweenness(spark.createDataFrame([(a, b, 1) for a, b in sorted(pairs)], "de string, para string, weight int")).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert sum(df.columns == ["place", "share"] for df in cut) == -(-n // 300) == 3  # rounds
