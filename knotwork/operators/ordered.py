"""Running totals and ranks over ordered rows without one task for a whole group.

Rows are dealt into ranges of (group, order); each range counts alone, and only
groups that go on from one range into the next need what came before: at most
two groups a range, so the carried totals are few rows whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def running(df: DataFrame, group: list[str], order: list[str | Column], add: dict[str, Column] | None = None, xor: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each name in add (xor), the sum (exclusive or) of its long over the group's rows up to and with this one.

    A group without names is the whole table. Nulls in group are values of
    their own, nulls in order come first (as the given columns sort), null
    values count as 0. Rows that tie in order follow each other in an order of
    no meaning, each once; a group that holds all rows is dealt over all ranges.
    """
    parts = [(name, c, F.sum) for name, c in (add or {}).items()] + [(name, c, F.bit_xor) for name, c in (xor or {}).items()]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_value_{name}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for name, c, _ in parts}).withColumn("_at", F.monotonically_increasing_id())
    dealt = valued.repartitionByRange(ranges, *group, *order, "_at").withColumn("_range", F.spark_partition_id()).repartitionById(ranges, "_range")
    upto = Window.partitionBy("_range", *group).orderBy(*order, "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = checkpointed(dealt.withColumns({name: total(f"_value_{name}").over(upto) for name, _, total in parts}).drop("_at"))

    key = F.struct(*group) if group else F.struct(F.lit(0).alias("_all"))
    edges = local.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last")).select(F.explode(F.array("_first", "_last")).alias("_key")).distinct()
    totals = local.withColumn("_key", key).join(F.broadcast(edges), "_key", "left_semi").groupBy("_range", "_key").agg(*[total(f"_value_{name}").alias(f"_value_{name}") for name, _, total in parts])
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", "_key", *[total(f"_value_{name}").over(before).alias(f"_before_{name}") for name, _, total in parts]).where(F.col(f"_before_{parts[0][0]}").isNotNull())
    joined = local.withColumn("_key", key).join(F.broadcast(carried), ["_range", "_key"], "left")
    whole = {name: (F.col(name) + F.coalesce(f"_before_{name}", F.lit(0))) if total is F.sum else F.col(name).bitwiseXOR(F.coalesce(f"_before_{name}", F.lit(0).cast("long"))) for name, _, total in parts}
    return joined.withColumns(whole).select(*df.columns, *[name for name, _, _ in parts])


def placed(df: DataFrame, name: str) -> DataFrame:
    """df with name, a row's place from 0; df's partitions are ranges of an order, each sorted by it."""
    local = checkpointed(df.withColumn("_at", F.monotonically_increasing_id()))  # 33 bits are a row's place in its partition
    counts = local.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return local.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range").select(*df.columns, place.alias(name))


def ordinals(df: DataFrame, order: list[str | Column], name: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """df with name, its place from 0 in the order of its rows (of the rows of its group): dense ranks as row_number gives them, less 1."""
    return running(df, group or [], order, add={name: F.lit(1)}).withColumn(name, F.col(name) - 1)
