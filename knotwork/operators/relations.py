"""From mentions to links, sentence by sentence. Every window and pair stays within one sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extraction import IDENTIFIERS, OWNERS

#: Cues, case-insensitive, matched on the whole sentence (kin: on what stands between two persons).
CUES = {
    "partner": r"(?i)s[óo]ci[oa]s?|administrador|diretor|propriet[áa]ri[oa]|don[oa] d[aeo]",
    "member": r"(?i)integra|formad[oa] p|comp[õo]e|participa",
    "phone": r"(?i)telefone|celular|ligar|whatsapp",
    "email": r"(?i)e-?mail|correio",
    "address": r"(?i)endere[çc]o|sede|localizad|situad|domic[íi]lio",
}
KIN = r"(?i)(irm[ãa]o?|filh[oa]|m[ãa]e|pai|espos[oa]|marido|prim[oa]|ti[oa]|cunhad[oa]|genro|nora|sobrinh[oa]) d[aeo]s? *$"


def relations(sents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sent, de, para, weight, label; each unordered pair of a sentence keeps its strongest link.

    kin: the nearest person before a kinship noun that ends right before a person. partner: a
    person and a company each nearest to the other, or one to the other, with a cue. integra:
    companies by consortia, with a cue. Identifiers go to the nearest owner before them, else
    after. co-citation: all other pairs of a sentence but two identifiers. However many entities a
    sentence has, all are linked; a sentence has LONGEST characters at most, and so few pairs.
    """
    first = Window.partitionBy("doc_id", "sent", "id").orderBy("pos")
    m = found.where(~F.col("kind").endswith("_number")).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    cues = sents.select("doc_id", "sent", "s", *[F.col("s").rlike(p).alias(k) for k, p in CUES.items()])
    here = ["doc_id", "sent"]
    place = Window.partitionBy(*here).orderBy("pos")

    persons = m.where("kind = 'person'").withColumn("before", F.lag(F.struct("id", "end")).over(place)).where("before is not null").join(cues, here)
    between = F.expr("substring(s, greatest(before.end, pos - 40) + 1, pos - greatest(before.end, pos - 40))")
    kin = persons.where(between.rlike(KIN)).select(*here, F.col("before.id").alias("de"), F.col("id").alias("para"), F.lit(2).alias("weight"), F.lit("kin").alias("label"))

    side = lambda kind, name: m.where(F.col("kind") == kind).select(*here, F.col("id").alias(name), F.col("pos").alias(f"{name}_at"))
    pairs = side("person", "de").join(side("company", "para"), here).join(cues.where("partner").select(*here), here).withColumn("far", F.abs(F.col("de_at") - F.col("para_at")))
    rank = lambda one, other: F.row_number().over(Window.partitionBy(*here, one).orderBy("far", other))
    partner = pairs.withColumn("x", rank("de", "para_at")).withColumn("y", rank("para", "de_at")).where("x = 1 or y = 1").select(*here, "de", "para", F.lit(2), F.lit("partner"))

    member = side("company", "de").join(side("consortium", "para"), here).join(cues.where("member").select(*here), here).select(*here, "de", "para", F.lit(2), F.lit("integra"))

    owner = F.when(F.col("kind").isin(*OWNERS), F.col("id"))
    held = m.withColumn("was", F.last(owner, True).over(place.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first(owner, True).over(place.rowsBetween(1, Window.unboundedFollowing)))
    cued = F.when(F.col("kind") == "phone", F.col("phone")).when(F.col("kind") == "email", F.col("email")).otherwise(F.col("address"))
    held = held.where(F.col("kind").isin(*IDENTIFIERS)).join(cues, here).where(cued).select(*here, F.coalesce("was", "next").alias("de"), F.col("id").alias("para"), F.lit(2), F.col("kind")).where("de is not null")

    named = m.select(*here, "id", "pos", F.col("kind").isin(*IDENTIFIERS).alias("thing"))
    near = named.toDF(*here, "de", "p", "t").join(named.toDF(*here, "para", "q", "u"), here).where("(p < q or p = q and de < para) and not (t and u)").select(*here, "de", "para", F.lit(1), F.lit("co-citation"))

    every = kin.union(partner).union(member).union(held).union(near).where("de <> para")
    strongest = Window.partitionBy(*here, F.least("de", "para"), F.greatest("de", "para")).orderBy(F.desc("weight"), "label", "de")
    return every.withColumn("r", F.row_number().over(strongest)).where("r = 1").drop("r")
