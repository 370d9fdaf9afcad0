"""Source divergence audit: how far the sources of a language stand apart, and by which terms.

Terms are counted inside tasks and then by (language, source, term). Smoothed
shares are exact integers in billionths. Divergence of two sources is a sum over
every kept term, but only terms that occur are ever looked at: the sum for two
sources without any term is a product, terms of one source correct it by a
histogram of that source's counts, and terms of both by a join on the term.

A group's strongest terms are found by radix select: histograms over the bits of
the values, from the highest, give the k-th value of every group; ties at it are
refined by histograms over the bytes of the term. Only what can be among the
first k is ever ordered.

Defined cases: null text, lang and source are empty strings; every row is a
document, whatever its doc_id (also none, or a repeated one). A group without
terms has pairs and no term rows; a language with one source has no pairs;
without kept terms all its values are 0. An empty table gives no rows. Long
texts are counted whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Terms of bytes of UTF-8: letters of ASCII and all beyond it.
TERM = re.compile(rb"[a-z\x80-\xff]+")
FOLD = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
#: Counters that a task holds before it hands them on, and bytes of a text that it cuts into terms at a time.
HELD, SLICE = 90_000, 1 << 20
#: Bits and bytes of a radix digit; rows of a group that are ordered instead of being split further.
BITS, BYTES, FEW = 12, 2, 1000
GROUP = ["lang", "source"]


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def _slices(raw: bytes):
    """A text in pieces of about SLICE bytes that end between terms."""
    at = 0
    while len(raw) - at > SLICE:
        end = next((m.start() for m in re.finditer(rb"[^a-z\x80-\xff]", raw[at + SLICE :])), len(raw) - at - SLICE) + at + SLICE
        yield raw[at:end]
        at = end
    yield raw[at:]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it), summed over all rows."""

    def run(batches):
        import pyarrow as pa

        held, size = {}, 0

        def flush():
            for (lang, source), (n, docs) in held.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, here = len(n), set()
                for piece in _slices(text.as_buffer().to_pybytes().translate(FOLD)):
                    n.update(terms := TERM.findall(piece))
                    here.update(terms)
                in_docs.update(here)
                size += len(n) - before
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    common.bounded_batches(docs.sparkSession)
    each = _named(docs, *GROUP, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # tasks have counted already: a second count before the shuffle would only cost
    return each.repartition(*GROUP, "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exact: three digits at a time, so that no product leaves 64 bits."""
    of = total + 2 * kept
    out, rest = F.lit(0).cast("long"), count + 2
    for _ in range(3):
        # the first quotient is at most 1000 and each rest is below ``of``
        out, rest = out * 1000 + _div(rest * 1000, of), (rest * 1000) % of
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def radix_top(rows: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank of the k largest values (not negative) of each group, equal ones by the bytes of item; items differ within a group."""
    rows = common.cut(rows.select(*GROUP, "item", "value"))
    most = rows.agg(F.max("value")).first()[0] or 0
    by = lambda order: Window.partitionBy(*GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def chosen(digits: DataFrame, order: Column) -> DataFrame:
        """The digit that holds each group's wanted row (the first whose cumulative count is enough) with what is left to want inside it."""
        hist = digits.groupBy(*GROUP, "left", "digit").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(by(order)))
        return hist.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left"))).select(*GROUP, "digit", "n", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))

    # groups of at most k rows need no threshold
    open_ = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > k).select(*GROUP, F.lit(0).cast("long").alias("high"), F.lit(k).cast("long").alias("left"))
    for shift in reversed(range(0, max(1, most.bit_length()), BITS)):
        inside = rows.join(common.small(common.cut(open_)), GROUP).where(F.shiftright("value", shift + BITS) == F.col("high"))
        digits = inside.select(*GROUP, "high", "left", (F.shiftright("value", shift) % (1 << BITS)).alias("digit"))
        found = chosen(digits, F.col("digit").desc())
        open_ = open_.select(*GROUP, "high").join(found, GROUP).select(*GROUP, (F.shiftleft("high", BITS) + F.col("digit")).alias("high"), "left", "n")
    held = common.cut(open_.withColumnRenamed("high", "least"))

    # ties at the threshold: the first ``left`` of them by bytes; a prefix bounds them once few rows share it
    raw = F.col("item").cast("binary")
    ties = rows.join(common.small(held), GROUP).where("value = least")
    bounds, open_, at = None, held.where(F.col("n") > FEW).select(*GROUP, F.lit(b"").alias("prefix"), "left"), 0
    while open_.limit(1).count():
        inside = ties.drop("left").join(common.small(open_), GROUP).where(F.substring(raw, 1, at) == F.col("prefix"))
        found = chosen(inside.select(*GROUP, "left", F.substring(raw, at + 1, BYTES).alias("digit")), F.col("digit").asc())
        step = common.cut(open_.drop("left").join(found, GROUP).select(*GROUP, F.concat("prefix", "digit").alias("prefix"), "left", "n", (F.octet_length("digit") < BYTES).alias("ended")))
        settled = step.where((F.col("n") <= FEW) | F.col("ended")).select(*GROUP, "prefix")
        bounds, at = settled if bounds is None else bounds.union(settled), at + BYTES
        open_ = step.where((F.col("n") > FEW) & ~F.col("ended")).select(*GROUP, "prefix", "left")
    edge = rows.join(common.small(held.select(*GROUP, "least")), GROUP, "left").where("least is null or value >= least")
    if bounds is not None:
        within = F.col("prefix").isNull() | (F.col("value") > F.col("least")) | (F.substring(raw, F.lit(1), F.octet_length("prefix")) <= F.col("prefix"))
        edge = edge.join(common.small(common.cut(bounds)), GROUP, "left").where(within)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item"))
    return edge.select(*GROUP, "item", "value", rank.alias("rank")).where(F.col("rank") <= k)


def divergence(docs: DataFrame, least: int = 10, k: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: the contract's rows, for terms of at least ``least`` documents of a language and ranks of terms to k."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumns({"in_lang": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term), "first": (F.min("source").over(of_term) == F.col("source")).cast("long")}).where(F.col("in_lang") >= least)
    c = common.cut(counted.select(*GROUP, "term", "n", "n_lang", "first"))
    kept = c.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("total_lang"))
    totals = c.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = _named(docs, *GROUP).distinct().join(totals, GROUP, "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "total_lang"])
    # a kept term makes the divisor at least 2; without one no share is asked for
    base = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    groups = common.cut(groups.withColumn("base", base.cast("long")))
    small = common.small(groups)

    shares = c.join(small, GROUP).withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))})
    terms = shares.where("p > q").select(*GROUP, F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    top = radix_top(terms, k).withColumn("part", F.lit("term"))

    one, two = (small.select("lang", F.col("source").alias(f"source_{s}"), F.col("base").alias(f"base_{s}"), *(["kept"] if s == "x" else [])) for s in "xy")
    bare = one.join(common.small(two), "lang").where("source_x <> source_y").select("lang", "source_x", "source_y", (F.col("kept") * apart(F.col("base_x"), F.col("base_y"))).alias("value"))
    p = shares.select("lang", "source", "term", "n", "p", "base")
    alike = p.groupBy("lang", F.col("source").alias("source_x"), F.col("base").alias("base_x"), "p").agg(F.count("*").alias("terms"))
    alone = alike.join(common.small(two), "lang").where("source_x <> source_y").groupBy("lang", "source_x", "source_y").agg(F.sum(F.col("terms") * (apart(F.col("p"), F.col("base_y")) - apart(F.col("base_x"), F.col("base_y")))).alias("value"))
    x, y = (p.select("lang", "term", F.col("source").alias(f"source_{s}"), F.col("p").alias(f"p_{s}"), F.col("base").alias(f"base_{s}")) for s in "xy")
    both_more = apart(F.col("p_x"), F.col("p_y")) - apart(F.col("p_x"), F.col("base_y")) - apart(F.col("base_x"), F.col("p_y")) + apart(F.col("base_x"), F.col("base_y"))
    shared = x.join(y, ["lang", "term"]).where("source_x < source_y").groupBy("lang", "source_x", "source_y").agg(F.sum(both_more).alias("value"))
    turned = lambda df: df.select("lang", F.col("source_y").alias("source_x"), F.col("source_x").alias("source_y"), "value")
    parts = [bare, alone, turned(alone), shared, turned(shared)]
    summed = parts[0]
    for more in parts[1:]:
        summed = summed.unionByName(more)
    pairs = summed.groupBy("lang", F.col("source_x").alias("source"), F.col("source_y").alias("item")).agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumns({"rank": rank, "part": F.lit("pair")})
    return ranked.unionByName(top).select(*GROUP, "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def query(spark, sf_dir):
    return divergence(common.documents(spark, sf_dir))


SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
  select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term from words group by lang, term having count(distinct id) >= 10
), sizes as (
  select g.lang, coalesce(v, 0) as v from (select distinct lang from d) g left join (select lang, count(*) as v from kept group by lang) using (lang)
), c as (
  select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
), lang_p as (
  select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) as q
  from (select lang, term, sum(n) as n from c group by all) join sizes using (lang)
), grid as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n from (select distinct lang, source from d) g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), group_p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) as p from grid join sizes using (lang)
), pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from group_p a join group_p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), all_pairs as (
  select a.lang, a.source, b.source as item, coalesce(p.value, 0) as value
  from (select distinct lang, source from d) a join (select distinct lang, source from d) b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
), terms as (
  select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from group_p join lang_p using (lang, term) where n > 0 and p > q
), ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from all_pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
