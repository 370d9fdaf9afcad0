"""What rounds over the graph leave on disk."""

from knotwork.operators import graph

LINKS = [(f"n{i % 40:02}", f"n{i * 7 % 40:02}", 1 + i % 3) for i in range(400)]


def test_links_are_dealt_once_to_stay_by_node(spark, monkeypatch):
    plans, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    links = spark.createDataFrame(LINKS, "de string, para string, weight int")
    near = graph.near_by(links, "dst")
    assert len(plans) == 1 and plans[0].count("Exchange hash") == 1  # pairs were dealt to be added up, and again by node
    monkeypatch.undo()
    assert {tuple(r) for r in near.collect()} == {tuple(r) for r in graph.adjacency(links).collect()}
    joined = near.join(graph._shuffled(near.select("dst").distinct().withColumn("label", graph.F.length("dst"))), "dst")
    joined.collect()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_rounds_let_go_of_what_they_no_longer_need(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(graph, "freed", lambda session: calls.append(session), raising=False)
    links = spark.createDataFrame(LINKS, "de string, para string, weight int")
    for run in (lambda: graph.communities(links, 2), lambda: graph.ordered_communities(links, 2), lambda: graph.path_costs(graph.near_by(links, "src"), "n00", dealt=True)):
        before = len(calls)
        run()
        assert len(calls) > before


def test_nodes_that_choose_again_deal_only_their_own_links(spark):
    links = spark.createDataFrame(LINKS, "de string, para string, weight int")
    near = graph.near_by(links, "dst")
    labels = spark.createDataFrame([(f"n{i:02}", f"n{i // 2:02}", f"n{i // 3:02}") for i in range(40)], "node string, was string, now string")
    every = {r.node: r.new for r in graph._chosen(near, labels, None).collect()}
    some = spark.createDataFrame([("n03",), ("n11",)], "node string")
    got = graph._chosen(near, labels, some)
    assert {r.node: r.new for r in got.collect()} == {n: every[n] for n in ("n03", "n11") if n in every}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # all links were joined to labels, then sieved
