"""The link graph of the relational tables: who is tied to what, how strongly, and on what evidence.

Classes of evidence weigh 3 (official), 2 (declared) and 1 (inferred). Suppliers
are companies, customers persons, parts identifiers, nations addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import spread, tasks

OFFICIAL, DECLARED, INFERRED = 3, 2, 1
OWNERS, IDENTIFIERS = ("company", "person"), ("part", "address")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def of_orders(line: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines joined to their orders, dealt to as many tasks as their size asks for."""
    n = max(tasks(line), tasks(orders))
    return spread(line, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """de, para, weight, label, source, day: one row for each piece of evidence."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("day"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    weight = F.when(F.col("l_returnflag") == "A", OFFICIAL).when(F.col("l_returnflag") == "R", DECLARED).otherwise(INFERRED)
    supplies = line.select(node("company", "l_suppkey").alias("de"), node("part", "l_partkey").alias("para"), weight.alias("weight"), F.lit("supplies").alias("label"), F.col("l_linestatus").alias("source"), "day")
    partner = of_orders(line, urgent).select(node("person", "o_custkey"), node("company", "l_suppkey"), F.lit(DECLARED), F.lit("partner"), "l_linestatus", "day")
    home = [table(spark, sf_dir, t).select(node(kind, key), node("address", nation), F.lit(OFFICIAL), F.lit("located"), F.lit("registry"), F.lit(None).cast("date")) for t, kind, key, nation in (("customer", "person", "c_custkey", "c_nationkey"), ("supplier", "company", "s_suppkey", "s_nationkey"))]
    return supplies.union(partner).union(home[0]).union(home[1])


#: The same graph for DuckDB.
LINKS_SQL = """links as (
  select 'company:' || l_suppkey as de, 'part:' || l_partkey as para, case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end as weight, 'supplies' as label, l_linestatus as source, cast(l_shipdate as date) as day from lineitem
  union all select 'person:' || o_custkey, 'company:' || l_suppkey, 2, 'partner', l_linestatus, cast(l_shipdate as date) from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT'
  union all select 'person:' || c_custkey, 'address:' || c_nationkey, 3, 'located', 'registry', null from customer
  union all select 'company:' || s_suppkey, 'address:' || s_nationkey, 3, 'located', 'registry', null from supplier
)"""
