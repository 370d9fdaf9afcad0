import random
from collections import defaultdict, deque

import pytest

from knotwork.operators import graph


def _brandes(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(near)
    return {v: t / ((n - 1) * (n - 2)) for v, t in total.items()}


@pytest.fixture(scope="module")
def session(spark):
    spark.sparkContext.setCheckpointDir("/tmp/spark-checkpoint-tests")
    return spark


def _links(session, pairs):
    return session.createDataFrame([(a, b, w) for a, b, w in pairs], "de string, para string, weight int")


def test_betweenness(session):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(22)] + [("x", "y"), ("n1", "n1")]
    want = _brandes([p for p in pairs if p[0] != p[1]])
    got = {x.node: x.betweenness for x in graph.betweenness(_links(session, [(*p, 1) for p in pairs])).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert graph.betweenness(_links(session, [("a", "b", 1)])).count() == 2 and graph.betweenness(_links(session, [])).count() == 0


def test_communities_and_bridges(session):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 3) for i in range(5) for j in range(i)]
    g = _links(session, clique("a") + clique("b") + [("a0", "b0", 1)])
    got = {x.node: x.community for x in graph.communities(g).collect()}
    assert got == {f"{p}{i}": f"{p}0" for p in "ab" for i in range(5)}
    spans = {x.node for x in graph.bridges(graph.betweenness(g), graph.communities(g), g).collect()}
    assert spans == {"a0", "b0"}
