"""Queries over exports, seals, signals and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cases import analysing, building
from ..functions import scalars
from ..operators import export, extraction, graph, integrity, relations, signals
from ..sources import importers
from ..sources.tables import links, node, of_orders, table
from ..streaming.calls import windowed_pairs
from .registry import OVERLAP_SQL, calls, query

EDGES_SQL = ", e as (select de, para, weight, label, count(*)::bigint as n, min(day)::varchar as first_day, array_to_string(list_sort(list(distinct source)), '|') as sources from links group by 1, 2, 3, 4)"
NODES_SQL = ", v as (select node, split_part(node, ':', 1) as kind, count(*)::bigint as degree from (select de as node from links union all select para from links) group by 1)"


@query("export_edges", EDGES_SQL + " select * from e", True)
def _(spark, sf):
    return export.edges(links(spark, sf))


@query("export_nodes", NODES_SQL + " select * from v", True)
def _(spark, sf):
    return export.nodes(links(spark, sf))


@query("export_mermaid", EDGES_SQL + NODES_SQL + """ select 'n' || substr(md5(node), 1, 12) || '["' || node || '"]:::' || kind as line from v
union all select 'n' || substr(md5(de), 1, 12) || ' ' || case weight when 3 then '==>' when 2 then '-->' else '-.->' end || '|"' || label || '"| n' || substr(md5(para), 1, 12) from e""", True)
def _(spark, sf):
    return export.mermaid(links(spark, sf))


@query("export_graphml", EDGES_SQL + NODES_SQL + """ select '<node id="' || node || '"><data key="kind">' || kind || '</data></node>' as line from v
union all select '<edge id="e' || (row_number() over (order by de, para, weight, label) - 1) || '" source="' || de || '" target="' || para || '"><data key="weight">' || weight || '</data><data key="label">' || label || '</data><data key="sources">' || sources || '</data></edge>' from e""", True)
def _(spark, sf):
    return export.graphml(links(spark, sf))


@query("edge_ordinals", EDGES_SQL + " select de, para, weight, label, n, first_day, sources, row_number() over (order by de, para, weight, label) - 1 as ordinal from e", True)
def _(spark, sf):
    return export.numbered_edges(links(spark, sf))


@query("node_ordinals", NODES_SQL + " select node, kind, degree, row_number() over (order by node) - 1 as ordinal from v", True)
def _(spark, sf):
    return export.numbered_nodes(links(spark, sf))


@query("export_bundle")
def _(spark, sf):
    return export.bundle(export.unwritten(links(spark, sf)), "Links", "2024-01-01T00:00:00.000Z", export.written)


@query("export_exchange")
def _(spark, sf):
    return export.exchange(links(spark, sf))


SEAL_SQL = """, h as (select h, count(*) as n from (select sha256('{' || coalesce('"day":"' || day || '",', '') || '"de":"' || de || '","label":"' || label || '","para":"' || para || '","source":"' || source || '","weight":' || weight || '}') as h from links) group by 1),
a as (select substr(h, 1, 6) as h, sha256(string_agg(h || ':' || n, ',' order by h || ':' || n)) as v, sum(n) as n from h group by 1),
b as (select substr(h, 1, 4) as h, sha256(string_agg(v, ',' order by v)) as v, sum(n) as n from a group by 1),
c as (select substr(h, 1, 2) as h, sha256(string_agg(v, ',' order by v)) as v, sum(n) as n from b group by 1)
select sha256(string_agg(v, ',' order by v)) as content, sum(n)::bigint as n, sha256(repeat('0', 64) || sha256(string_agg(v, ',' order by v))) as root from c"""


@query("seal_links", SEAL_SQL, True)
def _(spark, sf):
    return integrity.seal(links(spark, sf))


@query("source_chain", """with s as (select n_regionkey as case_id, list(sha256(n_name) order by n_nationkey) as l from nation group by 1)
select case_id, list_reduce(l, lambda x, y: sha256(x || y), repeat('0', 64)) as chain from s""")
def _(spark, sf):
    return integrity.source_chain(table(spark, sf, "nation").select(F.col("n_regionkey").alias("case_id"), F.col("n_nationkey").alias("ordinal"), F.sha2("n_name", 256).alias("sha256")))


@query("overlap_alerts", OVERLAP_SQL.replace("\nselect a, b, common::bigint", ", o as (select a, b, common::bigint") + """)
select a, b, common, weight, case when common >= 3 and weight >= 6 then 'high' else 'medium' end as level from (select * from o order by weight desc, common desc, a, b limit 10) where weight >= 4""", True)
def _(spark, sf):
    return signals.overlap_alerts(graph.overlap(links(spark, sf), "company", "part"))


KIN_SQL = ", kin as (select x.c_custkey as x, y.c_custkey as y from customer x join customer y on y.c_custkey = x.c_custkey + 1 and x.c_nationkey = y.c_nationkey), held as (select distinct de as person, para as company from links where label = 'partner'), k as (select least('person:' || x, 'person:' || y) as a, greatest('person:' || x, 'person:' || y) as b from kin)"


@query("kinship_conflicts", KIN_SQL + """ select distinct a, b from k where a in (select person from held) and b in (select person from held)
and not exists (select 1 from held p join held q on p.company = q.company where p.person = a and q.person = b)""", True)
def _(spark, sf):
    c = table(spark, sf, "customer")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_nationkey", F.col("c_custkey").alias("y"))
    kin = c.join(after, ["c_custkey", "c_nationkey"]).select(node("person", "c_custkey").alias("a"), node("person", "y").alias("b"))
    return signals.kinship_conflicts(kin, links(spark, sf).where("label = 'partner'").select(F.col("de").alias("person"), F.col("para").alias("company")))


EXIT_SQL = """, l as (select de, para, weight, label from links where label = 'partner' union all select 'person:' || o_custkey, 'company:' || l_suppkey, 3, 'ex-partner' from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R')
select least(de, para) as a, greatest(de, para) as b, (count(*) filter (where weight = 3 and label like '%ex-%'))::bigint as official, (count(*) filter (where weight = 2 and label like '%partner%'))::bigint as declared from l group by 1, 2
having count(*) filter (where weight = 3 and label like '%ex-%') > 0 and count(*) filter (where weight = 2 and label like '%partner%') > 0"""


@query("contradiction_exit", EXIT_SQL, True)
def _(spark, sf):
    left = of_orders(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    left = left.select(node("person", "o_custkey").alias("de"), node("company", "l_suppkey").alias("para"), F.lit(3).alias("weight"), F.lit("ex-partner").alias("label"))
    return signals.exits(links(spark, sf).where("label = 'partner'").select("de", "para", "weight", "label").union(left), "ex-", "partner")


@query("contradiction_addresses", """, l as (select de, para, weight from links where label = 'located' and de like 'company:%' union all select p.para, a.para, 2 from links p join links a on p.de = a.de and p.label = 'partner' and a.label = 'located')
select de as node, count(distinct para)::bigint as addresses from l group by 1 having count(distinct para) >= 2 and max(weight) = 3""", True)
def _(spark, sf):
    g = links(spark, sf)
    at = g.where("label = 'located'").select("de", "para", "weight")
    through = g.where("label = 'partner'").select("de", F.col("para").alias("company")).distinct().join(at.select("de", "para"), "de").select(F.col("company").alias("de"), "para", F.lit(2).alias("weight"))
    return signals.conflicting_addresses(at.union(through))


@query("nickname_conflicts", "select p_size as number, count(distinct lower(trim(split_part(p_type, ' ', 1))))::bigint as names from part group by 1 having count(distinct lower(trim(split_part(p_type, ' ', 1)))) >= 2")
def _(spark, sf):
    return signals.nicknames(table(spark, sf, "part").select(F.col("p_size").alias("number"), F.substring_index("p_type", " ", 1).alias("name")))


@query("independent_parties")
def _(spark, sf):
    """Owners of an address; a person and the companies they are partner of count once."""
    g = links(spark, sf)
    return signals.independent_parties(g.where("label = 'located'").select(F.col("para").alias("node"), F.col("de").alias("owner")), g.where("label = 'partner'").select(F.col("de").alias("person"), F.col("para").alias("company")))


@query("plain_text", r"select doc_id, sha256(trim(lower(regexp_replace(regexp_replace(translate(text, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')))) as plain_sha256 from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(scalars.plain(F.col("text")), 256).alias("plain_sha256"))


@query("flexible_dates", """select o_orderkey as key, case o_orderkey % 4 when 3 then make_date(year(o_orderdate)::int, 1, 1) when 2 then date_trunc('month', o_orderdate)::date else o_orderdate::date end as day,
case o_orderkey % 4 when 3 then 'a' when 2 then 'm' else 'd' end as precision from orders""")
def _(spark, sf):
    form = F.col("o_orderkey") % 4
    raw = F.when(form == 3, F.date_format("o_orderdate", "yyyy")).when(form == 2, F.date_format("o_orderdate", "MM/yyyy")).when(form == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), scalars.flexible_date(raw).alias("d")).select("key", "d.day", "d.precision")


@query("duration_seconds", "select event_id, (event_id % 10000)::bigint as seconds from events")
def _(spark, sf):
    s = F.col("event_id") % 10000
    raw = F.when(F.col("event_id") % 2 == 0, F.format_string("%d:%02d:%02d", (s / 3600).cast("long"), (s / 60).cast("long") % 60, s % 60)).otherwise(F.concat(s.cast("string"), F.lit(",7")))
    return table(spark, sf, "events").select("event_id", scalars.seconds(raw).alias("seconds"))


@query("page_texts")
def _(spark, sf):
    return importers.page_texts(table(spark, sf, "pages"))


@query("windowed_pairs", "select date_trunc('day', ts)::timestamp as start, a, b, count(*)::bigint as n, sum(floor(value))::bigint as seconds from (select user_id as a, json_extract_string(props, '$.k')::bigint as b, ts, value from events) where a <> b group by 1, 2, 3")
def _(spark, sf):
    return windowed_pairs(calls(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))


@query("communities")
def _(spark, sf):
    return graph.communities(links(spark, sf))


@query("betweenness")
def _(spark, sf):
    return graph.betweenness(links(spark, sf))


@query("bridges")
def _(spark, sf):
    g = links(spark, sf)
    return graph.bridges(graph.betweenness(g), graph.communities(g), g)


def _mentions(spark, sf):
    sents = graph.checkpointed(extraction.telling_sentences(table(spark, sf, "documents").select("doc_id", "text")))  # few are left
    return sents, graph.checkpointed(extraction.mentions(sents))  # read by several branches


@query("text_mentions")
def _(spark, sf):
    return _mentions(spark, sf)[1]


@query("text_entities")
def _(spark, sf):
    return extraction.entities(_mentions(spark, sf)[1])


@query("text_relations")
def _(spark, sf):
    return relations.relations(*_mentions(spark, sf))


@query("merge_suggestions")
def _(spark, sf):
    return extraction.merge_suggestions(extraction.entities(_mentions(spark, sf)[1]))


def _case(spark, sf):
    """All documents of a language as the reports of one case."""
    docs = table(spark, sf, "documents").where("doc_id is not null")
    return building.build(spark, [], docs.select(F.coalesce("lang", F.lit("")).alias("case_id"), F.col("doc_id").alias("src"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), "text"))


@query("case_entities")
def _(spark, sf):
    return _case(spark, sf).entities.drop("ord")


@query("case_links")
def _(spark, sf):
    return _case(spark, sf).links.drop("ord")


@query("case_pivots")
def _(spark, sf):
    return analysing.pivots(_case(spark, sf).links)


@query("cheapest_path")
def _(spark, sf):
    g = links(spark, sf)
    edges = graph.near_by(g, "src")
    costs = graph.path_costs(edges, "company:1", dealt=True)
    far = costs.orderBy(F.desc("cost"), F.desc("hops"), "node").limit(1).first()
    each = g.select("de", "para", "weight", "label", F.array("source").alias("sources"))  # the path's few links alone are compared
    return graph.cheapest_path(edges, each, "company:1", far.node, costs)


@query("ordered_communities")
def _(spark, sf):
    return graph.ordered_communities(links(spark, sf))
