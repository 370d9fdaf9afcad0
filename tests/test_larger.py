"""Steps that once grew faster than their input: results against the plain way, and bounds on what they make."""

from collections import Counter
from itertools import combinations

from knotwork.operators import graph


def test_shared_counts_of_frequent_and_rare_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 20)
    monkeypatch.setattr(graph, "SIDE", 16)
    rows = {(k, n) for n in range(70) for k in range(12) if (n * 7 + k * k) % (2 + k) == 0} | {(k, n) for n in range(0, 70, 9) for k in range(40, 44)} | {(90, 500), (90, 3), (91, 500)}
    want = Counter(pair for key in {k for k, _ in rows} for pair in combinations(sorted(n for k, n in rows if k == key), 2))
    assert max(Counter(k for k, _ in rows).values()) > 20  # some keys go through blocks, some through the join
    df = graph.shared_counts(spark.createDataFrame(sorted(rows), "key long, node long"))
    assert {(r.node_x, r.node_y): r.n for r in df.collect()} == dict(want)
    assert graph.shared_counts(spark.createDataFrame([(1, 2), (1, 5)], "key long, node long")).collect() == [(2, 5, 1)]
    # pairs of frequent keys are never rows of a shuffle: groups of two blocks read each node once a block
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_components_shrink_their_edges(spark, monkeypatch):
    n, cut = 600, []
    edges = [(f"n{i:04}", f"n{i + 1:04}") for i in range(n) if i % 50] + [("n0700", "n0700")] + [("hub", f"m{i:03}") for i in range(300)]
    want = {a: f"n{a_ // 50 * 50 + 1:04}" if a_ % 50 else f"n{a_ - 49:04}" for a_ in range(1, n + 1) for a in [f"n{a_:04}"]} | {"n0700": "n0700", "hub": "hub"} | {f"m{i:03}": "hub" for i in range(300)}
    kept = graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (out := kept(df), cut.append((out.columns, out.count())))[0])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == want
    whole = [rows for columns, rows in cut if columns == ["src", "dst"]]
    assert whole[0] == len(edges) and sum(whole) < 1.5 * len(edges)  # every round looked at all edges before, both ways


def test_parties_send_only_ties_through_components(spark, monkeypatch):
    from knotwork.operators import signals

    seen, whole = [], signals.components
    monkeypatch.setattr(signals, "components", lambda edges: (seen.append(edges.count()), whole(edges))[1])
    owned = spark.createDataFrame([("x", o) for o in "pqabc"] + [("y", "p"), ("y", "q")], "node string, owner string")
    partners = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "z")], "person string, company string")
    assert {(r.node, r.parties) for r in signals.independent_parties(owned, partners).collect()} == {("x", 3), ("y", 2)}  # p with a and b, q, c; p, q
    assert seen == [2]


def test_names_of_frequent_words_meet_only_their_like(spark, monkeypatch):
    from knotwork.cases import resolving

    seen, by_parts = [], resolving._by_parts
    monkeypatch.setattr(resolving, "_by_parts", lambda some: (seen.append(some.count()), by_parts(some))[1])
    words = ("brax", "clem", "dosk", "fint")
    names = [f"{a}brax {b}clem gulp{c}" for a in words for b in words for c in words]  # all share parts of five letters
    odd = ["braxbrax braxclem gulpbrix", "a" + "bcdefghij" * 8, "a" + "bcdefghij" * 7 + "bcdefghix"]
    keys = spark.createDataFrame([("c", "company", k, i, False) for i, k in enumerate([*names, *odd])], "case_id string, kind string, key string, first long, documented boolean")
    got = {r.key: r.parent for r in resolving.spellings(keys).collect()}
    every = [*names, *odd]
    like = lambda new, old: resolving.SequenceMatcher(None, new, old).ratio() >= 0.92 and (new[0] == old[0] or new[-1] == old[-1])
    want = {new: next(old for old in every[:i] if like(new, old)) for i, new in enumerate(every) if any(like(new, old) for old in every[:i])}
    assert got == want and len(want) >= 2
    assert seen == [2]  # only the two long names, whose subsequences are too many, look for parts in common


def test_suggestions_look_for_two_words_together(spark):
    from knotwork.cases import resolving

    rows = [("company", f"common frequent w{i}") for i in range(40)] + [("company", "frequent w7"), ("company", "w7"), ("company", "w9 common"), ("person", "ana maria lima"), ("person", "ana lima"), ("person", "lima ana"), ("person", "ana costa lima")]
    keys = spark.createDataFrame([("c", kind, k, i, False, k, k) for i, (kind, k) in enumerate(rows)], "case_id string, kind string, key string, first long, documented boolean, root string, id string")
    got = {frozenset((r.a, r.b)) for r in resolving.alike_names(keys).collect()}
    want = {frozenset(p) for p in (("frequent w7", "common frequent w7"), ("w9 common", "common frequent w9"), ("ana lima", "ana maria lima"), ("ana lima", "ana costa lima"))}
    assert got == want


def test_rounds_join_edges_where_they_are(spark):
    edges = spark.createDataFrame([(f"n{i % 40}", f"n{i * 7 % 40}", 1 + i % 3) for i in range(400)], "src string, dst string, weight int")
    kept = graph.kept_by(edges, "dst")
    joined = kept.join(graph._shuffled(kept.select("dst").distinct().withColumn("label", graph.F.length("dst"))), "dst")
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 400 and "BroadcastHashJoin" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_cheapest_path_of_known_costs_and_links_of_one_source_each(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b", 3, "x", "s2"), ("a", "b", 3, "x", "s1"), ("c", "b", 2, "y", None), ("c", "b", 2, "y", "s9"), ("a", "c", 1, "z", "s3")], "de string, para string, weight int, label string, source string")
    edges = graph.adjacency(links)
    costs = graph.path_costs(edges, "a")
    monkeypatch.setattr(graph, "path_costs", None)
    rows = graph.cheapest_path(edges, links.select("de", "para", "weight", "label", graph.F.array("source").alias("sources")), "a", "c", costs).collect()
    assert [tuple(r) for r in rows] == [(0, "a", "b", 3, "x", "s1"), (1, "b", "c", 2, "y", "s9")]


def test_betweenness_of_many_blocks_and_slices(spark, monkeypatch):
    import random
    from collections import deque

    r = random.Random(8)
    pairs = {tuple(sorted((f"n{r.randrange(60):02}", f"n{r.randrange(60):02}"))) for _ in range(110)} | {("hub", f"n{i:02}") for i in range(0, 60, 3)} | {(f"t{i}", f"t{i + 1}") for i in range(9)}
    near = {}
    for a, b in sorted(p for p in pairs if p[0] != p[1]):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    n = len(near)
    picks = {x.node for x in spark.createDataFrame([(v,) for v in near], "node string").where(graph.F.pmod(graph.F.xxhash64("node"), graph.F.lit(-(-n // 20))) == 0).collect()}
    want = dict.fromkeys(near, 0.0)
    for s in picks:
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
            want[w] += share[w] * n / len(picks) / ((n - 1) * (n - 2))
    for name, value in (("NODES", 16), ("CELLS", 48), ("PIECE", 20), ("AT_ONCE", 7)):
        monkeypatch.setattr(graph, name, value)
    kept, cut = graph.checkpointed, []
    monkeypatch.setattr(graph, "checkpointed", lambda df: (out := kept(df), cut.append(out))[0])
    links = spark.createDataFrame([(a, b, 1) for a, b in sorted(pairs)], "de string, para string, weight int")
    got = {x.node: x.betweenness for x in graph.betweenness(links, most=20, exact=10).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert not any("paths" in df.columns for df in cut)  # a row a source and node met a row an edge before
    levels = [df for df in cut if "slice" in df.columns]
    assert max(x.block for df in levels for x in df.collect()) >= 4 and max(x.slice for df in levels for x in df.collect()) >= 2


def test_bridges_look_at_the_neighbours_of_the_best_alone(spark, monkeypatch):
    monkeypatch.setattr(graph, "adjacency", None)  # every link was made a neighbour before
    links = spark.createDataFrame([("a", "b", 3), ("b", "a", 2), ("a", "a", 1), ("c", "a", 1), ("d", "b", 2), ("e", "d", 1)], "de string, para string, weight int")
    central = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("d", 0.1), ("c", 0.0)], "node string, betweenness double")
    groups = spark.createDataFrame([(n, g) for n, g in zip("abcde", "aacaa")], "node string, community string")
    got = graph.bridges(central, groups, links, top=2)
    assert got.columns == ["node", "betweenness", "communities"] and [tuple(r) for r in got.collect()] == [("a", 0.5, 2)]


def test_sentences_look_for_short_forms_once(spark):
    from knotwork.functions import scalars

    df = spark.createDataFrame([("Na Av. A.\n\n\nO Dr. B. Fim",)], "t string").select(scalars.sentences(graph.F.col("t")).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1  # it stood in each branch of a condition before
    assert df.first().s == ["Na Av A.", "O Dr B.", "Fim"]


def test_patterns_are_tried_only_where_they_may_match():
    import re

    from knotwork.operators import extraction

    tried = []

    class Told:
        def __init__(self, kind, pattern):
            self.kind, self.pattern = kind, re.compile(pattern)

        def finditer(self, s):
            tried.append(self.kind)
            return self.pattern.finditer(s)

    told = {k: Told(k, p) for k, p in extraction.PATTERNS.items()}
    assert [m[2:4] for m in extraction.find("Ana Lima mora na Rua Onze, 5", None, {}, told)] == [("person", "Ana Lima"), ("address", "Rua Onze, 5")]
    assert tried == ["address", "person"]  # all eight before
    every = "A Via Sul S/A, a Onda EPP e o Consórcio Norte: ana@x.co, (11) 91234-5678, 12.345.678/0001-90, 123.456.789-01, Av. Um."
    assert {m[2] for m in extraction.find(every, None, {}, told)} >= {"company", "consortium", "email", "phone", "company_number", "person_number", "address"}


def test_overlap_adds_pairs_up_where_they_meet(spark, monkeypatch):
    import random

    r = random.Random(6)
    monkeypatch.setattr(graph, "BLOCK", 9)
    monkeypatch.setattr(graph, "PAIRS", 25)
    monkeypatch.setattr(graph, "OUT", 7)
    rows = [(f"company:{r.randrange(30)}", f"part:{r.randrange(12)}", r.randint(1, 3)) for _ in range(90)] + [(f"company:{i}", "part:all", 1 + i % 3) for i in range(30)] + [("person:1", "part:1", 3), ("company:1", "address:1", 3)]
    best = {}
    for a, k, w in rows:
        if a[0] == "c" and k[0] == "p":
            best[a, k] = max(w, best.get((a, k), 0))
    near = {}
    for (a, k), w in best.items():
        near.setdefault(a, {})[k] = w
    want = {}
    for a, b in combinations(sorted(near), 2):
        both = near[a].keys() & near[b].keys()
        if len(both) >= 2:
            want[a, b] = (len(both), sum(min(near[a][k], near[b][k]) for k in both), len(both) / len(near[a].keys() | near[b].keys()))
    links = spark.createDataFrame(rows, "de string, para string, weight int")
    df = graph.overlap(links, "company", "part")
    got = df.collect()
    assert df.dtypes == [("a", "string"), ("b", "string"), ("common", "bigint"), ("weight", "bigint"), ("jaccard", "double")]
    assert len(got) == len(want) > 20 and all(want[x.a, x.b][:2] == (x.common, x.weight) and abs(want[x.a, x.b][2] - x.jaccard) < 1e-12 for x in got)
    monkeypatch.setattr(graph, "BLOCK", 40)
    few = graph.overlap(links.where("para <> 'part:all'"), "company", "part")
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 2 and "sum(weight" not in plan  # a row for each pair and neighbour went through a join and an aggregate before
    assert graph.overlap(links.where("false"), "company", "part").count() == 0


def _files(spark, tmp_path, monkeypatch, rows, columns):
    """rows as Parquet of two pieces, of which a task takes few bytes."""
    monkeypatch.setattr(graph, "TASK", 200)
    spark.createDataFrame(rows, columns).coalesce(2).write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_exits_are_dealt_to_more_tasks_as_files_grow(spark, tmp_path, monkeypatch):
    from knotwork.operators import signals

    rows = [(f"p{i % 90}", f"c{i % 7}", 2, "partner") for i in range(300)] + [(f"c{i % 7}", f"p{i}", 3, "ex-partner") for i in range(0, 90, 4)]
    links = _files(spark, tmp_path, monkeypatch, rows, "de string, para string, weight int, label string")
    df = signals.exits(links, "ex-", "partner")
    both = {tuple(sorted(r[:2])) for r in rows[:300]} & {tuple(sorted(r[:2])) for r in rows[300:]}
    assert {(r.a, r.b) for r in df.collect()} == both and both
    assert df.rdd.getNumPartitions() == graph.tasks(links) > 4  # as many as the session's before, whatever the input


def test_lines_meet_orders_in_more_tasks_as_files_grow(spark, tmp_path, monkeypatch):
    from knotwork.sources import tables

    lines = _files(spark, tmp_path, monkeypatch, [(i % 40, i) for i in range(400)], "l_orderkey long, l_partkey long")
    df = tables.of_orders(lines, spark.createDataFrame([(i,) for i in range(0, 40, 2)], "o_orderkey long").hint("merge"))
    assert df.count() == 200 and df.rdd.getNumPartitions() == graph.tasks(lines) > 4


def test_years_are_counted_in_more_tasks_as_files_grow(spark, tmp_path, monkeypatch):
    import datetime

    rows = [(f"p{i % 90}", f"c{i % 7}", 2, "partner", datetime.date(2000 + i // 100 % (1 + i % 3), 1, 1)) for i in range(700)]
    links = _files(spark, tmp_path, monkeypatch, rows, "de string, para string, weight int, label string, day date")
    seen = {}
    for de, para, _, _, day in rows:
        seen.setdefault((de, para), set()).add(day.year)
    df = graph.conflicting_years(links)
    assert {(r.de, r.para): (r.years, r.first_year, r.last_year) for r in df.collect()} == {k: (len(y), min(y), max(y)) for k, y in seen.items() if len(y) > 1}
    assert df.rdd.getNumPartitions() == graph.tasks(links) > 4


def test_edges_are_sorted_once_in_as_many_tasks_as_files_ask_for(spark, tmp_path, monkeypatch):
    from knotwork.operators import export

    rows = [(f"p{i % 30}", f"c{i % 7}", 2, "partner", (None, "b", "a", "c")[i // 210 % 4], None) for i in range(700)] + [("p1", "x", 1, None, None, None)] * 3
    links = _files(spark, tmp_path, monkeypatch, rows, "de string, para string, weight int, label string, source string, day date")
    seen = {}
    for r in rows:
        seen.setdefault(r[:4], []).append(r[4])
    want = {k: (len(s), "|".join(sorted({x for x in s if x}))) for k, s in seen.items()}
    df = export.edges(links)
    assert {tuple(r[:4]): (r.n, r.sources) for r in df.collect()} == want
    assert df.rdd.getNumPartitions() == graph.tasks(links) > 4 and "ObjectHashAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    placed = sorted(export.numbered_edges(links).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in placed] == list(range(len(want)))
    assert [tuple(r[:4]) for r in placed] == sorted(want, key=lambda k: (*k[:3], k[3] or ""))


def test_graphml_takes_its_nodes_from_its_edges(spark, monkeypatch):
    from knotwork.operators import export

    monkeypatch.setattr(export, "nodes", None)  # links were read and joined again for them before
    links = spark.createDataFrame([("person:1", "company:2", 2, "x", "s", None), ("company:2", "company:2", 2, "x", "s", None)], "de string, para string, weight int, label string, source string, day date")
    lines = [r.line for r in export.graphml(links).collect()]
    assert sorted(x for x in lines if x.startswith("<node")) == [f'<node id="{n}"><data key="kind">{n[:-2]}</data></node>' for n in ("company:2", "person:1")] and len(lines) == 4


def test_exchange_writes_the_links_of_a_node_next_to_each_other(spark):
    import json

    from knotwork.operators import export

    links = spark.createDataFrame([(f"person:{i % 20}", f"company:{i}", 2, "x", "s", None) for i in range(600)], "de string, para string, weight int, label string, source string, day date")
    of = [json.loads(r.object)["source_ref"] for r in export.exchange(links).collect() if r.type == "relationship"]
    changes = sum(a != b for a, b in zip(of, of[1:]))
    assert len(of) == 600 and len(set(of)) == 20 and changes < 20 + 4  # a run for each node and partition at most 80 before


def test_bundle_keeps_no_texts_of_objects(spark, monkeypatch):
    from knotwork.operators import export

    kept, cut = export.checkpointed, []
    monkeypatch.setattr(export, "checkpointed", lambda df: (cut.append(df.columns), kept(df))[1])
    links = spark.createDataFrame([(f"person:{i % 20}", f"company:{i}", 2, "x", "s", None) for i in range(300)] + [("company:1", "address:1", 3, "y", "s", None)], "de string, para string, weight int, label string, source string, day date")
    objects = {r.id: r.object for r in export.exchange(links).collect()}
    rows = export.bundle(export.unwritten(links), "t", "c", export.written).collect()
    assert cut and not any("object" in c for c in cut)
    ids = sorted(objects)
    assert [r.line.lstrip(",").strip('"') for r in sorted(rows, key=lambda r: r.place) if r.part == 1] == ids
    assert [r.line for r in sorted(rows, key=lambda r: r.place) if r.part == 3] == ["," + objects[i] for i in ids]
    odd = ["", "x", "a--", "a--b", "a--bcd--e", "a-", "a", "a--bce", "aa--b", "é--1"]
    plain = export.bundle(spark.createDataFrame([(i, "{}") for i in odd], "id string, object string"), "t", "c").collect()
    assert [r.line.lstrip(",").strip('"') for r in sorted(plain, key=lambda r: r.place) if r.part == 1] == sorted(odd, key=str.encode)
