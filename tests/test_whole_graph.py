import datetime
import heapq
from collections import defaultdict

import pytest
from knotwork.operators import graph
from knotwork.plans import registry

DAY = datetime.date(2024, 1, 2)
LINES = [(1, 1, 1, "A"), (1, 2, 2, "R"), (2, 2, 1, "N"), (3, 3, 3, "N"), (4, 4, 4, "A"), (4, 5, 3, "R")]  # order, supplier, part, flag
ORDERS = [(1, 1, "1-URGENT"), (2, 2, "5-LOW"), (3, 3, "1-URGENT"), (4, 4, "5-LOW")]
#: Suppliers 6 to 10 hang on each other by parts alone, so the cheapest path to the last part has 10 hops and costs 20.
CHAIN = [(5, 6 + (i + 1) // 2, 10 + i // 2, "A") for i in range(9)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir("/tmp/spark-checkpoint-tests")
    out = str(tmp_path_factory.mktemp("tables"))
    lines = [(o, s, p, f, "O", DAY) for o, s, p, f in LINES + CHAIN + [(5, 1, 10, "A")]]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string, l_shipdate date"),
        "orders": (ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string"),
        "part": ([(p, p % 5) for p in range(1, 20)], "p_partkey long, p_size int"),  # none of size 7
        "customer": ([(c, c % 3 + 1) for c in range(1, 6)], "c_custkey long, c_nationkey long"),
        "supplier": ([(s, 4 + s % 2) for s in range(1, 5)], "s_suppkey long, s_nationkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def near(spark, folder):
    best = defaultdict(dict)
    for r in registry.links(spark, folder).collect():
        for a, b in ((r.de, r.para), (r.para, r.de)):
            best[a][b] = max(best[a].get(b, 0), r.weight)
    return best


def test_components(spark, folder, near):
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            if (v := stack.pop()) not in want:
                want[v] = start
                stack += near[v]
    assert len(set(want.values())) > 1
    assert {r.node: r.component for r in registry.QUERIES["connected_components_whole"](spark, folder).collect()} == want


def test_path_costs(spark, folder, near):
    want, queue = {}, [(0, 0, "company:1")]
    while queue:
        cost, hops, v = heapq.heappop(queue)
        if v not in want:
            want[v] = (cost, hops)
            for w, weight in near[v].items():
                heapq.heappush(queue, (cost + {3: 2, 2: 3, 1: 6}[weight], hops + 1, w))
    assert max(c for c, _ in want.values()) > 16 and max(h for _, h in want.values()) > 8
    assert {r.node: (r.cost, r.hops) for r in registry.QUERIES["shortest_path_cost_whole"](spark, folder).collect()} == want


def test_reports_take_every_link(spark, folder, monkeypatch):
    every = registry.links(spark, folder).count()
    monkeypatch.setattr(graph, "communities", lambda g: g)
    monkeypatch.setattr(graph, "betweenness", lambda g: g)
    monkeypatch.setattr(graph, "bridges", lambda central, groups, g: g)
    for name in ("communities", "betweenness", "bridges"):
        assert registry.QUERIES[name](spark, folder).count() == every
