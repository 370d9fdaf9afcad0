"""Iterative and blocked graph operators against plain versions on random graphs."""

import heapq
import random
from collections import defaultdict

from knotwork.operators import graph

COST = {3: 2, 2: 3, 1: 6}


def _near(rows):
    near = defaultdict(dict)
    for a, b, w in rows:
        if a != b:
            near[a][b] = near[b][a] = max(w, near[a].get(b, 0))
    return near


def test_communities_in_order(spark):
    """One sweep after another over all nodes in order, on forty graphs at once."""
    r = random.Random(3)
    rows = [(f"g{g}n{r.randrange(9)}", f"g{g}n{r.randrange(9)}", r.randint(1, 3)) for g in range(40) for _ in range(r.randint(4, 16))]
    near = _near(rows)
    label = {v: v for v in near}
    for _ in range(50):
        moved = False
        for v in sorted(near):
            votes = defaultdict(int)
            for u, w in near[v].items():
                votes[label[u]] += w
            best = sorted(k for k, w in votes.items() if w == max(votes.values()))
            if label[v] not in best:
                label[v], moved = best[0], True
        if not moved:
            break
    first = {k: min(v for v in label if label[v] == k) for k in label.values()}
    links = spark.createDataFrame(rows, "de string, para string, weight int")
    assert {x.node: x.community for x in graph.ordered_communities(links).collect()} == {v: first[k] for v, k in label.items()}


def test_cheapest_path(spark):
    r = random.Random(7)
    rows = list({(a, b): (a, b, r.randint(1, 3), r.choice("xyz"), [r.choice("st")]) for a, b in ((f"n{r.randrange(14)}", f"n{r.randrange(14)}") for _ in range(30))}.values()) + [("far", "away", 3, "x", ["s"])]
    links = spark.createDataFrame(rows, "de string, para string, weight int, label string, sources array<string>")
    edges, near = graph.checkpointed(graph.adjacency(links)), _near([x[:3] for x in rows])
    start = min(v for v in near if v.startswith("n"))
    best, before, queue = {start: (0, 0)}, {}, [(0, 0, start)]
    done = set()
    while queue:
        c, h, v = heapq.heappop(queue)
        if v in done:
            continue
        done.add(v)
        for u, w in sorted(near[v].items()):
            if (c + COST[w], h + 1) < best.get(u, (10**9, 0)):
                best[u], before[u] = (c + COST[w], h + 1), v
                heapq.heappush(queue, (c + COST[w], h + 1, u))
    costs = graph.checkpointed(graph.path_costs(edges, start))
    assert {x.node: (x.cost, x.hops) for x in costs.collect()} == best
    assert {x.node: x.before for x in graph.predecessors(edges, costs).collect()} == before
    end = max((v for v in best), key=lambda v: best[v])
    way = [end]
    while way[-1] != start:
        way.append(before[way[-1]])
    got = graph.cheapest_path(edges, links, start, end).collect()
    assert [x.de for x in got] + [end] == way[::-1] and sum(COST[x.weight] for x in got) == best[end][0]
    for x in got:
        assert (x.weight, x.label) == min(((w, lab) for a, b, w, lab, _ in rows if {a, b} == {x.de, x.para}), key=lambda t: (-t[0], t[1]))
    assert graph.cheapest_path(edges, links, start, "away") is None and graph.cheapest_path(edges, links, "nobody", end) is None
    assert graph.cheapest_path(edges, links, start, start).count() == 0 == graph.path_costs(edges, "nobody").count()


def test_pairs_of_a_hot_key(spark, monkeypatch):
    """A key with a third of all rows is paired in blocks, and every pair comes once."""
    monkeypatch.setattr(graph, "BLOCK", 16)
    rows = [(0, f"n{i:03d}", i) for i in range(150)] + [(1 + i % 100, f"n{i:03d}", i) for i in range(300)]
    got = [(x.k, x.node_x, x.node_y, x.v_x, x.v_y) for x in graph.block_pairs(spark.createDataFrame(rows, "k int, node string, v int"), ["k"]).collect()]
    want = {(k, a, b, v, w) for k, a, v in rows for j, b, w in rows if j == k and a < b}
    assert len(got) == len(want) and set(got) == want


def test_islands_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPAN", 7)
    r = random.Random(2)
    numbers = [(g, r.randrange(400)) for g in "ab" for _ in range(40)] + [("c", 5), ("d", 1), ("d", 11), ("d", 21), ("d", 32)]
    want = set()
    for g in "abcd":
        run = []
        for n in sorted({n for x, n in numbers if x == g}) + [10**9]:
            if run and n - run[-1] > 10:
                if len(run) > 1:
                    want.add((g, run[0], run[-1], len(run)))
                run = []
            run.append(n)
    assert {tuple(x) for x in graph.islands(spark.createDataFrame(numbers, "grp string, number long")).collect()} == want


def test_block_pairs_of_small_and_large_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    r = random.Random(6)
    for sizes in ((3, 5, 7), (3, 8, 40, 100)):
        rows = [(f"k{i}", n, r.randint(0, 9)) for i, size in enumerate(sizes) for n in r.sample(range(500), size)]
        got = graph.block_pairs(spark.createDataFrame(rows, "k string, node int, w int"), ["k"])
        want = sorted((k, a, w, b, v) for k, a, w in rows for k2, b, v in rows if k == k2 and a < b)
        assert sorted((x.k, x.node_x, x.w_x, x.node_y, x.w_y) for x in got.collect()) == want


def test_pivots_apart_equal_counted_parties(spark):
    from knotwork.operators import signals

    r = random.Random(9)
    owned = [(f"n{r.randrange(30)}", f"o{r.randrange(12)}") for _ in range(120)]
    partners = [(f"o{r.randrange(12)}", f"o{r.randrange(12)}") for _ in range(25)]
    a, b = spark.createDataFrame(owned, "node string, owner string"), spark.createDataFrame(partners, "person string, company string")
    want = sorted(x.node for x in signals.independent_parties(a, b).where("parties > 1").collect())
    assert sorted(x.node for x in signals.apart(a, b).collect()) == want and len(want) > 5


def test_communities_of_one_large_component(spark):
    """A ring with chords, all one component: the sweeps in order, by joins, equal those of a loop; so do numbers and names."""
    r = random.Random(13)
    n = 3000
    rows = [(f"person:{i:05}", f"company:{(i + d) % n:05}", r.randint(1, 3)) for i in range(n) for d in (0, 1)] + [(f"person:{r.randrange(n):05}", f"company:{r.randrange(n):05}", 1) for _ in range(n // 3)]
    near = _near(rows)
    label = {v: v for v in near}
    for _ in range(50):
        moved = False
        for v in sorted(near):
            votes = defaultdict(int)
            for u, w in near[v].items():
                votes[label[u]] += w
            best = sorted(k for k, w in votes.items() if w == max(votes.values()))
            if label[v] not in best:
                label[v], moved = best[0], True
        if not moved:
            break
    groups = defaultdict(list)
    for v in sorted(label):
        groups[label[v]].append(v)
    links = spark.createDataFrame(rows, "de string, para string, weight int")
    got = graph.checkpointed(graph.ordered_communities(links))
    assert {x.node: x.community for x in got.collect()} == {v: m[0] for m in groups.values() for v in m} and len(groups) > 100
    want = {}
    for k, m in enumerate(sorted(groups.values(), key=lambda m: (-len(m), m[0])), 1):
        top = sorted(m, key=lambda v: (-len(near[v]), v))[:2]
        want[m[0]] = (k, len(m), f"Grupo {k} — {', '.join(top)}")
    assert {x.community: (x.number, x.size, x.label) for x in graph.community_names(got, links).collect()} == want
    # labels of nodes that are no owners name nobody
    assert {x.label for x in graph.community_names(spark.createDataFrame([("phone:1", "phone:1")], "node string, community string"), links).collect()} == {"Grupo 1 — sem donos"}
