"""From what a sentence names to links with evidence: L1 to L8. Every window and pair stays within one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicon as L

HERE = ["case_id", "src", "sent"]
EVIDENCE = ["case_id", "de", "para", "weight", "label", "source", "excerpt", "day", "precision", "n", "directed", "ord"]


def _nearest_date(a: str, b: str) -> Column:
    """L1: the date nearest to the middle between two positions, the first of equals."""
    ranked = F.array_min(F.transform("dates", lambda d, i: F.struct(F.abs(2 * d["pos"] - F.col(a) - F.col(b)).alias("far"), i.alias("i"), d["iso"].alias("iso"), d["precision"].alias("precision"))))
    return F.when(F.size("dates") > 0, ranked)


def relate(read: DataFrame, named: DataFrame) -> DataFrame:
    """Evidence of what sentences say. read: their text, dates and flat text; named: case_id, src, sent, ord, pos, kind, label, id."""
    first = Window.partitionBy(*HERE, "id").orderBy("ord")
    m = named.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    s = read.select(*HERE, "source", "s", "dates", "flat", *[F.col("flat").rlike(p).alias(f"says_{k}") for k, p in L.CUES.items()])
    place = Window.partitionBy(*HERE).orderBy("pos", "ord")
    of = lambda c: F.col("kind").isin(*c)
    side = lambda kinds, name, rows=m: rows.where(of(kinds)).select(*HERE, F.col("id").alias(name), F.col("pos").alias(f"{name}_at"), F.col("ord").alias(f"{name}_ord"), F.col("kind").alias(f"{name}_kind"))

    # kinship: a noun that ends right before a person ties that person to the one before
    from .reading import plain_texts

    persons = m.where(of(["person"])).withColumn("before", F.lag(F.struct("id", "pos")).over(place)).join(s.select(*HERE, "s"), HERE)
    start = F.greatest(F.col("pos") - L.KIN_REACH, F.lit(0))
    ahead = F.concat(plain_texts(F.substring("s", start + 1, F.col("pos") - start)), F.lit(" "))
    after = plain_texts(F.substring("s", F.col("pos") + F.length("label") + 1, F.lit(L.KIN_REACH)))
    persons = persons.withColumn("noun", F.regexp_extract(ahead, L.KIN, 1)).withColumn("after", after)
    kin = persons.where("noun <> '' and before is not null").select(*HERE, F.col("before.id").alias("de"), F.col("id").alias("para"), F.col("before.pos").alias("de_at"), F.col("pos").alias("para_at"), F.lit(2).alias("weight"), F.concat(F.lit("parente ("), F.replace("noun", F.lit("ex-"), F.lit("ex ")), F.lit(")")).alias("label"))
    # a relative is no partner just for standing in the sentence, unless a cue follows the name
    partners = persons.where((F.col("noun") == "") | F.col("after").rlike(L.CUES["partner"]))

    pairs = side(["person"], "de", partners).join(side(L.ORGANISATIONS, "para"), HERE).join(s.where("says_partner").select(*HERE), HERE)
    pairs = pairs.withColumn("n", F.count("*").over(Window.partitionBy(*HERE))).where(F.col("n") <= L.PAIRS).withColumn("far", F.abs(F.col("de_at") - F.col("para_at")))
    rank = lambda one, other: F.row_number().over(Window.partitionBy(*HERE, one).orderBy("far", other))
    declared = lambda rows, label: rows.select(*HERE, "de", "para", "de_at", "para_at", F.lit(2).alias("weight"), label.alias("label"))
    partner = declared(pairs.withColumn("x", rank("de", "para_ord")).withColumn("y", rank("para", "de_ord")).where("x = 1 or y = 1"), F.lit(L.PARTNER))
    member = declared(side(["company"], "de").join(side(["consortium"], "para"), HERE).join(s.where("says_member").select(*HERE), HERE), F.lit(L.MEMBER))

    # identifiers: to the owner before, else the first after; cues of sharing add others
    held = side(L.OWNERS, "de").join(side(L.IDENTIFIERS, "para"), HERE).join(s.select(*HERE, *[f"says_{k}" for k in ("phone", "email", "address", "same", "shared")]), HERE)
    of_one = Window.partitionBy(*HERE, "para")
    held = held.withColumn("before", F.col("de_at") < F.col("para_at")).withColumn("any_before", F.max("before").over(of_one))
    held = held.withColumn("nearest", F.row_number().over(Window.partitionBy(*HERE, "para", "before").orderBy(F.when(F.col("before"), -F.col("de_at")).otherwise(F.col("de_at")), "de_ord")))
    cue = F.when(F.col("para_kind") == "phone", F.col("says_phone")).when(F.col("para_kind") == "email", F.col("says_email")).otherwise(F.col("says_address"))
    main = (F.col("nearest") == 1) & (F.col("before") == F.col("any_before"))
    shared = F.col("says_shared") & ~F.col("before")
    same = F.col("says_same") & F.col("before") & (F.col("para_at") - F.col("de_at") <= L.SHARED_REACH)
    held = held.withColumn("told", cue & (main | shared | same))
    uses = declared(held.where("told"), F.create_map(*[F.lit(x) for kv in L.USES.items() for x in kv])[F.col("para_kind")])

    said = kin.unionByName(partner).unionByName(member).unionByName(uses)
    few = m.withColumn("n", F.count("*").over(Window.partitionBy(*HERE))).where(F.col("n") <= L.TOGETHER_MOST)
    both = side((*L.OWNERS, *L.IDENTIFIERS), "de", few).join(side((*L.OWNERS, *L.IDENTIFIERS), "para", few), HERE).where("de_at < para_at or de_at = para_at and de_ord < para_ord").where(~(F.col("de_kind").isin(*L.IDENTIFIERS) & F.col("para_kind").isin(*L.IDENTIFIERS)))
    together = both.select(*HERE, "de", "para", "de_at", "para_at").union(held.where("not told").select(*HERE, "de", "para", "de_at", "para_at"))
    together = together.select(*HERE, F.least("de", "para").alias("de"), F.greatest("de", "para").alias("para"), F.when(F.col("de") < F.col("para"), F.col("de_at")).otherwise(F.col("para_at")).alias("de_at"), F.when(F.col("de") < F.col("para"), F.col("para_at")).otherwise(F.col("de_at")).alias("para_at")).dropDuplicates([*HERE, "de", "para"])
    told = said.select(*HERE, F.least("de", "para").alias("de"), F.greatest("de", "para").alias("para")).distinct()
    together = together.join(told, [*HERE, "de", "para"], "left_anti").withColumn("weight", F.lit(1)).withColumn("label", F.lit(L.TOGETHER))

    every = said.unionByName(together).where("de <> para").join(s.select(*HERE, "source", "s", "dates"), HERE).withColumn("d", _nearest_date("de_at", "para_at"))
    return every.select(
        "case_id", "de", "para", "weight", "label", "source", F.substring("s", 1, L.EXCERPT).alias("excerpt"), F.col("d.iso").alias("day"), F.col("d.precision").alias("precision"),
        F.lit(None).cast("long").alias("n"), F.lit(False).alias("directed"), (F.col("src").cast("long") * (1 << 20) + F.col("sent")).alias("ord"),
    )


def close(evidence: DataFrame) -> DataFrame:
    """Distinct evidence without loops; what is only named together goes where a pair has more than that."""
    kept = evidence.where("de <> para").groupBy(*[c for c in EVIDENCE if c != "ord"]).agg(F.min("ord").alias("ord"))
    pair = ["case_id", F.least("de", "para").alias("x"), F.greatest("de", "para").alias("y")]
    strong = kept.where("weight > 1").select(*pair).distinct()
    weak = kept.where("weight = 1").withColumns({"x": F.least("de", "para"), "y": F.greatest("de", "para")}).join(strong, ["case_id", "x", "y"], "left_anti")
    return kept.where("weight > 1").select(EVIDENCE).union(weak.select(EVIDENCE))


def links(evidence: DataFrame) -> DataFrame:
    """A link for each (de, para, weight, label): with n, directed, the number of pieces of evidence, the first day, sources and ord."""
    return evidence.groupBy("case_id", "de", "para", "weight", "label").agg(
        F.max("n").alias("n"), F.bool_or("directed").alias("directed"), F.count("*").alias("pieces"), F.min("day").alias("first_day"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("ord").alias("ord")
    )
