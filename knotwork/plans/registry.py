"""Every query of the link-analysis engine and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cases.lexicon import STATES
from ..functions import scalars
from ..operators import graph
from ..sources.tables import LINKS_SQL, links, node, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, with_links: bool = False):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"with {LINKS_SQL}{sql}" if with_links else sql
        return f

    return register


PIVOT_SQL = """, owned as (select {node} as node, {owner} as owner, max(weight) as weight from links where {where} group by 1, 2)
select node, count(*)::bigint as owners, sum(weight)::bigint as score, sum(weight)::double / (count(*) - 1) as strength from owned group by node having count(*) >= 2"""


PARTIES_SQL = """, own as (select distinct para as node, de as owner from links where para like 'part:%' or para like 'address:%'),
ties as (select distinct o.node, p.de as x, p.para as y from own o join links p on p.label = 'partner' and p.de = o.owner join own q on q.node = o.node and q.owner = p.para),
near as (select node, x, y from ties union all select node, y, x from ties),
walk as (select node, owner, owner as part from own union select w.node, n.y, w.part from walk w join near n on n.node = w.node and n.x = w.owner),
apart as (select node from (select node, owner, min(part) as part from walk group by 1, 2) group by 1 having count(distinct part) > 1)"""


@query("pivots_shared_identifier", "with recursive " + LINKS_SQL + PARTIES_SQL + PIVOT_SQL.format(node="para", owner="de", where="(para like 'part:%' or para like 'address:%') and para in (select node from apart)"))
def _(spark, sf):
    return graph.shared_identifiers(links(spark, sf))


@query("pivots_common_partner", PIVOT_SQL.format(node="de", owner="para", where="label = 'partner'"), True)
def _(spark, sf):
    return graph.common_partners(links(spark, sf))


ADJACENCY = ", adj as (select src, dst, max(weight) as weight from (select de as src, para as dst, weight from links union all select para, de, weight from links) where src <> dst group by 1, 2)"


@query("adjacency_max_weight", ADJACENCY + " select src, dst, weight from adj", True)
def _(spark, sf):
    return graph.adjacency(links(spark, sf))


@query("degree_raw", " select node, count(*)::bigint as degree from (select de as node from links union all select para from links) group by 1", True)
def _(spark, sf):
    return graph.degree(links(spark, sf))


@query("link_counts_by_class", " select weight, count(*)::bigint as n from links group by 1", True)
def _(spark, sf):
    return graph.counts_by_class(links(spark, sf))


OVERLAP_SQL = """, near as (select de, para, max(weight) as weight from links where de like 'company:%' and para like 'part:%' group by 1, 2),
size as (select de, count(*) as size from near group by 1),
pairs as (select x.de as a, y.de as b, count(*) as common, sum(least(x.weight, y.weight)) as weight from near x join near y on x.para = y.para and x.de < y.de group by 1, 2 having count(*) >= 2)
select a, b, common::bigint as common, weight::bigint as weight, common::double / (s.size + t.size - common) as jaccard from pairs join size s on s.de = a join size t on t.de = b"""


@query("overlap_supplier_pairs", OVERLAP_SQL, True)
def _(spark, sf):
    return graph.overlap(links(spark, sf), "company", "part")


@query("density_alerts", " select para as node, count(distinct de)::bigint as owners from links where para like 'part:%' or para like 'address:%' group by 1 having count(distinct de) >= 4", True)
def _(spark, sf):
    return graph.dense_identifiers(links(spark, sf))


WEAK_SQL = """ select distinct de, para, weight, label from links l where weight > 1 or not exists (
  select 1 from links s where s.weight > 1 and least(s.de, s.para) = least(l.de, l.para) and greatest(s.de, s.para) = greatest(l.de, l.para))"""


@query("weak_link_suppression", WEAK_SQL, True)
def _(spark, sf):
    return graph.without_weak(links(spark, sf))


@query("timeline", " select day, de, para, label, count(*)::bigint as n from links where day is not null group by all", True)
def _(spark, sf):
    return graph.timeline(links(spark, sf))


TIMING_SQL = """, p as (select distinct para as company, day as d1 from links where label = 'partner'),
e as (select distinct de as company, day as d2 from links where label = 'supplies' and weight = 3)
select company, d1, d2, (d2 - d1)::bigint as days from p join e using (company) where d2 - d1 between 1 and 180"""


@query("timing_window_180", TIMING_SQL, True)
def _(spark, sf):
    g = links(spark, sf)
    return graph.timing(g.where("label = 'partner'").select(F.col("para").alias("company"), "day"), g.where("label = 'supplies' and weight = 3").select(F.col("de").alias("company"), "day"))


YEARS_SQL = """ select de, para, weight, label, count(distinct year(day))::bigint as years, min(year(day))::bigint as first_year, max(year(day))::bigint as last_year
from links where weight > 1 and day is not null group by 1, 2, 3, 4 having count(distinct year(day)) >= 2"""


@query("contradiction_years", YEARS_SQL, True)
def _(spark, sf):
    return graph.conflicting_years(links(spark, sf))


HOLDERS_SQL = """, held as (select para as node, de, max(weight) as w from links where para like 'part:%' and weight > 1 group by 1, 2)
select node, (count(*) filter (where w = 3))::bigint as official, (count(*) filter (where w = 2))::bigint as outside from held group by 1 having official > 0 and outside > 0"""


@query("contradiction_holders", HOLDERS_SQL, True)
def _(spark, sf):
    return graph.undeclared_holders(links(spark, sf))


CALLS = "select user_id as a, json_extract_string(props, '$.k')::bigint as b, ts, value from events"


def calls(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"), "ts", "value")


@query("cdr_pairs", f"select a, b, count(*)::bigint as n, sum(floor(value))::bigint as seconds, min(ts) as first, max(ts) as last, (count(*) filter (where hour(ts) >= 22 or hour(ts) < 5))::bigint as night from ({CALLS}) where b is not null and a <> b group by 1, 2")
def _(spark, sf):
    night = (F.hour("ts") >= 22) | (F.hour("ts") < 5)
    return calls(spark, sf).where("b is not null and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("seconds"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(night).alias("night"))


ISLANDS_SQL = """with f as (select grp, number, case when number - lag(number) over (partition by grp order by number) <= 10 then 0 else 1 end as new from (select distinct c_nationkey as grp, c_custkey as number from customer)),
r as (select *, sum(new) over (partition by grp order by number) as run from f)
select grp, min(number) as low, max(number) as high, count(*)::bigint as n from r group by grp, run having count(*) >= 2"""


@query("sequential_ids", ISLANDS_SQL)
def _(spark, sf):
    return graph.islands(table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("number")))


@query("shared_contacts", f"with c as (select distinct a, b from ({CALLS}) where b is not null) select x.a as a, y.a as b, count(*)::bigint as n from c x join c y on x.b = y.b and x.a < y.a group by 1, 2")
def _(spark, sf):
    c = calls(spark, sf).where("a is not null and b is not null").select(F.col("b").alias("key"), F.col("a").alias("node")).distinct()
    return graph.shared_counts(c).toDF("a", "b", "n")


@query("dispersion_regions", """, h as (select p.de as owner, n_regionkey as region from links p join links a on p.para = a.de and a.label = 'located' and p.label = 'partner' join nation on a.para = 'address:' || n_nationkey)
select owner, count(distinct region)::bigint as regions from h group by 1 having count(distinct region) >= 3""", True)
def _(spark, sf):
    g = links(spark, sf)
    at = g.where("label = 'located'").select(F.col("de").alias("company"), F.col("para").alias("address"))
    nation = table(spark, sf, "nation").select(node("address", "n_nationkey").alias("address"), "n_regionkey")
    held = g.where("label = 'partner'").select(F.col("de").alias("owner"), F.col("para").alias("company")).distinct().join(at, "company").join(nation, "address")
    return held.groupBy("owner").agg(F.countDistinct("n_regionkey").alias("regions")).where("regions >= 3")


@query("root_groups", "select substr(lpad(s_suppkey::varchar, 14, '0'), 1, 13) as root, count(*)::bigint as n, min(s_suppkey) as first from supplier group by 1 having count(*) >= 2")
def _(spark, sf):
    return table(spark, sf, "supplier").groupBy(F.substring(F.lpad(F.col("s_suppkey").cast("string"), 14, "0"), 1, 13).alias("root")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first")).where("n >= 2")


def _check_sql(key: str, size: int, weights: list[tuple[int, ...]]) -> str:
    sums = ["(" + " + ".join(f"substr(d, {i + 1}, 1)::int * {w}" for i, w in enumerate(ws)) + ") % 11" for ws in weights]
    right = " and ".join(f"substr(d, {len(ws) + 1}, 1)::int = case when {s} < 2 then 0 else 11 - {s} end" for ws, s in zip(weights, sums))
    return f"select key, d, (d <> repeat(substr(d, 1, 1), {size}) and {right}) as valid from (select {key} as key, lpad((({key} * 7919 + 12345) % 99999999999)::varchar, {size}, '0') as d from orders)"


def _padded(spark, sf, size):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lpad(((F.col("o_orderkey") * 7919 + 12345) % 99999999999).cast("string"), size, "0").alias("d"))


@query("company_number_check", _check_sql("o_orderkey", 14, [scalars.COMPANY_WEIGHTS, (6, *scalars.COMPANY_WEIGHTS)]))
def _(spark, sf):
    return _padded(spark, sf, 14).withColumn("valid", scalars.company_number_valid(F.col("d")))


@query("person_number_check", _check_sql("o_orderkey", 11, [tuple(range(10, 1, -1)), tuple(range(11, 1, -1))]))
def _(spark, sf):
    return _padded(spark, sf, 11).withColumn("valid", scalars.person_number_valid(F.col("d")))


PHONES_SQL = """with p as (select o_orderkey as key, '+55 (' || (11 + o_orderkey % 80)::varchar || ') 9' || lpad((o_orderkey % 100000000)::varchar, case when o_orderkey % 3 = 0 then 7 else 8 end, '0') as phone from orders),
d as (select key, phone, regexp_replace(phone, '[^0-9]', '', 'g') as d from p), e as (select key, phone, case when length(d) in (12, 13) and d like '55%' then substr(d, 3, 11) else d end as d from d)
"""


def _phones(spark, sf):
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, F.lpad((k % 100000000).cast("string"), 7, "0")).otherwise(F.lpad((k % 100000000).cast("string"), 8, "0"))
    phone = F.concat(F.lit("+55 ("), (11 + k % 80).cast("string"), F.lit(") 9"), tail)
    return table(spark, sf, "orders").select(k.alias("key"), phone.alias("phone")).withColumn("local", scalars.local_number(F.col("phone")))


@query("phone_normalise", PHONES_SQL + "select key, phone, case when length(d) in (10, 11) then d end as local from e")
def _(spark, sf):
    return _phones(spark, sf)


AREAS_SQL = "areas as (select unnest(string_split(codes, ' ')) as area, state from (values " + ", ".join(f"('{state}', '{codes}')" for state, codes in STATES.items()) + ") as t(state, codes))"


@query("phone_info", PHONES_SQL + ", " + AREAS_SQL + """ select key, '+55' || d as number, case when length(d) = 11 then 'mobile' else 'landline' end as kind, state
from e join areas on substr(d, 1, 2) = area where (length(d) = 11 and substr(d, 3, 1) = '9') or (length(d) = 10 and substr(d, 3, 1) between '2' and '5')""")
def _(spark, sf):
    return _phones(spark, sf).select("key", scalars.phone(F.col("local")).alias("p")).where("p is not null").select("key", "p.*")


@query("doc_sha256", "select doc_id, sha256(text) as sha256 from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("email_mentions", r"select doc_id, rtrim(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))), '.') as email from documents")
def _(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    return table(spark, sf, "documents").where("contains(text, '@')").select("doc_id", found.alias("m")).select("doc_id", F.rtrim(F.lower("m"), F.lit(".")).alias("email"))


SENTENCE_SQL = r"""with f as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r', '', 'g'), '\n{2,}', chr(1), 'g'), '\n', ' ', 'g') as t from documents),
s as (select doc_id, unnest(string_split(regexp_replace(t, '([.!?]) +([A-ZÀ-Ú"])', '\1' || chr(1) || '\2', 'g'), chr(1))) as s from f)
select doc_id, count(*)::bigint as sentences, sum(length(trim(s)))::bigint as chars from s where trim(s) <> '' group by 1"""


@query("sentence_split", SENTENCE_SQL)
def _(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(scalars.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


SMALL_SQL = """, small as (select de as src, para as dst, weight from links where label = 'located' and de like 'company:%'
  union all select 'company:' || l_suppkey, 'part:' || l_partkey, case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end from lineitem join part on l_partkey = p_partkey where p_size = 7),
adj as (select src, dst, max(weight) as weight from (select src, dst, weight from small union all select dst, src, weight from small) group by 1, 2)"""


def _small_links(spark, sf):
    """The filtered graph of the recursive SQL (SMALL_SQL): suppliers, nations, and parts of one size."""
    parts = table(spark, sf, "part").where("p_size = 7").select(node("part", "p_partkey").alias("para"))
    g = links(spark, sf).select("de", "para", "weight", "label")
    return g.where("label = 'located'").where(graph.kind("de") == "company").union(g.where("label = 'supplies'").join(parts, "para", "left_semi").select("de", "para", "weight", "label"))


def _small(spark, sf):
    return graph.adjacency(_small_links(spark, sf))


@query("connected_components", "with recursive " + LINKS_SQL + SMALL_SQL + """, walk as (select distinct src as node, src as component from adj union select a.dst, w.component from walk w join adj a on a.src = w.node)
select node, min(component) as component from walk group by 1""")
def _(spark, sf):
    return graph.components(_small(spark, sf))


@query("shortest_path_cost", "with recursive " + LINKS_SQL + SMALL_SQL + """, step as (select src, dst, case weight when 3 then 2 when 2 then 3 else 6 end as c from adj),
walk as (select 'company:1' as node, 0 as cost, 0 as hops union select s.dst, w.cost + s.c, w.hops + 1 from walk w join step s on s.src = w.node where w.hops < 8 and w.cost + s.c <= 16)
select node, (min({'c': cost, 'h': hops})).c::bigint as cost, (min({'c': cost, 'h': hops})).h::bigint as hops from walk group by 1""")
def _(spark, sf):
    return graph.path_costs(_small(spark, sf), "company:1")


# The two above answer their SQL's small graph; over every link the recursive SQL would not end, so these have none.


@query("connected_components_whole")
def _(spark, sf):
    return graph.components(links(spark, sf).select(F.col("de").alias("src"), F.col("para").alias("dst")).where("src <> dst"))


@query("shortest_path_cost_whole")
def _(spark, sf):
    return graph.path_costs(graph.adjacency(links(spark, sf)), "company:1")


from . import partners, reports  # noqa: E402,F401  (they register their queries)
