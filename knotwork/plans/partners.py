"""Cases made of the relational tables, with SQL for what the case builder must find in them.

Every urgent order is a report of the case of its customer's nation, a sentence for each supplier in it: who is
partner of what, by names that spell the keys, so that the case engine reads, resolves and links all of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cases import analysing, building
from ..operators import graph
from ..sources.tables import LINKS_SQL, links, table
from .registry import query

#: A syllable for each digit; names of two keys differ in three letters at least and are never spelled almost alike.
SYLLABLES = ("brax", "clem", "dosk", "fint", "gulp", "hyrn", "jwav", "kzet", "morb", "piqu")


def name(key: str):
    """Three words of two syllables each: the six last digits of a key."""
    digits = F.lpad(F.col(key).cast("string"), 6, "0")
    of = lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES)), F.substring(digits, i, 1).cast("int") + 1)
    return F.concat_ws(" ", *[F.initcap(F.concat(of(i), of(i + 1))) for i in (1, 3, 5)])


def reports(spark, sf):
    """case_id, src, source, text."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    held = urgent.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(line, "o_orderkey")
    said = F.concat(F.lit("Nil "), name("o_custkey"), F.lit(" é sócia da "), name("l_suppkey"), F.lit(" Ltda."))
    texts = held.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("case_id"), F.col("o_orderkey").alias("src"), said.alias("s")).groupBy("case_id", "src")
    return texts.agg(F.array_join(F.array_sort(F.collect_list("s")), "\n\n").alias("text")).select("case_id", "src", F.concat(F.lit("order "), F.col("src").cast("string")).alias("source"), "text")


def _spelled(key: str) -> str:
    words = (" || ' ' || ".join(f"syl[substr(lpad({key}::varchar, 6, '0'), {i}, 1)::int + 1] || syl[substr(lpad({key}::varchar, 6, '0'), {i + 1}, 1)::int + 1]" for i in (1, 3, 5)))
    return f"({words})"


SAID_SQL = f"""with syl as (select {list(SYLLABLES)} as syl), said as (
  select distinct 'nation ' || c_nationkey as case_id, o_orderkey as src, 'person:' || replace('nil ' || {_spelled("o_custkey")}, ' ', '-') as de, 'company:' || replace({_spelled("l_suppkey")}, ' ', '-') as para
  from syl, orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT')"""


def case(spark, sf) -> building.Case:
    return building.build(spark, [], reports(spark, sf))


@query("case_partner_links", SAID_SQL + " select case_id, de, para, 2 as weight, 'sócio/administrador' as label, count(distinct src)::bigint as pieces from said group by 1, 2, 3")
def _(spark, sf):
    return case(spark, sf).links.select("case_id", "de", "para", "weight", "label", "pieces")


@query("case_partner_entities", SAID_SQL + """, e as (select case_id, de as id, 'person' as kind, src from said union all select case_id, para, 'company', src from said)
select case_id, id, kind, false as review, false as warning from e group by 1, 2, 3""")
def _(spark, sf):
    return case(spark, sf).entities.select("case_id", "id", "kind", "review", "warning")


@query("case_partner_pivots", SAID_SQL + """, held as (select distinct case_id, de, para from said)
select case_id, de as node, 'common partner' as what, array_to_string(list_sort(list(para)), ',') as ties, 2 * count(*)::bigint as score, 2 * count(*)::double / (count(*) - 1) as strength from held group by 1, 2 having count(*) >= 2""")
def _(spark, sf):
    return analysing.pivots(case(spark, sf).links).select("case_id", "node", "what", F.array_join("ties", ",").alias("ties"), F.col("score").cast("long").alias("score"), "strength")


@query("address_groups", f"""with {LINKS_SQL}, seat as (select distinct de, para from links where label = 'located'), g as (select para, count(*) + 1 as size, list_sort(list(de))[1:2] as owners from seat group by 1)
select row_number() over (order by size desc, least(para, owners[1])) as number, least(para, owners[1]) as community, size::bigint as size, 'Grupo ' || row_number() over (order by size desc, least(para, owners[1])) || ' — ' || array_to_string(owners, ', ') as label from g""")
def _(spark, sf):
    """G4 over who is located where: a group for each nation, with its number and name."""
    at = links(spark, sf).where("label = 'located'").select("de", "para", "weight")
    return graph.community_names(graph.checkpointed(graph.ordered_communities(at)), at)
