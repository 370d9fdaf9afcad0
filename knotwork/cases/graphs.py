"""Graphs as documents: one JSON document a case, alone or inside a saved page: S10, K6.

A document is written a row a line behind constant parts, so it needs neither one task nor the driver, and is read
back whole, as a document is one value. The names of its fields are fixed values of the format.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordinals
from . import lexicon as L
from . import relating
from .building import Case
from .reporting import CLASSES

OPEN = '<script id="dados" type="application/json">'
SCHEMA = """meta struct<titulo: string, fontes: array<struct<nome: string, sha256: string, bytes: bigint>>>,
entidades array<struct<id: string, tipo: string, rotulo: string, aliases: array<string>, revisar: boolean, doc: string, aviso: boolean, apelidos: array<struct<nome: string, fonte: string, org: string>>>>,
vinculos array<struct<de: string, para: string, tipo: string, rotulo: string, dir: boolean, n: bigint, evidencias: array<struct<fonte: string, trecho: string, data: string, prec: string>>>>,
sugestoes_fusao array<array<string>>"""


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _renamed(c: str, kinds: Column) -> Column:
    """An identifier with the name of its kind, which stands before the first colon, in the other language."""
    kind = F.substring_index(c, ":", 1)
    return F.concat(F.coalesce(F.try_element_at(kinds, kind), kind), F.substring(c, F.length(kind) + 1, F.length(c)))


def document(case: Case, title: str = "", page: bool = False) -> DataFrame:
    """part, place, line of one case's document (export.write_document writes it); as a page its JSON stands in a script element."""
    spark, ours = case.entities.sparkSession, _map((k, p) for p, k in L.KINDS.items())
    named = lambda c: _renamed(c, ours)
    nick = case.nicknames.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("name").alias("nome"), F.col("source").alias("fonte"), "org"))).alias("apelidos"))
    told = F.struct(F.col("source").alias("fonte"), F.col("excerpt").alias("trecho"), F.col("day").alias("data"), F.col("precision").alias("prec"))
    pieces = case.evidence.groupBy("de", "para", "weight", "label").agg(F.array_sort(F.collect_list(told)).alias("evidencias"))
    entity = F.to_json(F.struct(named("id").alias("id"), F.try_element_at(ours, F.col("kind")).alias("tipo"), F.col("label").alias("rotulo"), "aliases", F.col("review").alias("revisar"), "doc", F.col("warning").alias("aviso"), "apelidos"))
    link = F.to_json(F.struct(named("de").alias("de"), named("para").alias("para"), F.try_element_at(_map(CLASSES.items()), F.col("weight")).alias("tipo"), F.col("label").alias("rotulo"), F.col("directed").alias("dir"), "n", "evidencias"))
    source = F.to_json(F.struct(F.col("source").alias("nome"), "sha256", "bytes"))
    parts = [
        (f'{{"meta":{{"titulo":{json.dumps(title, ensure_ascii=False)},"fontes":[', case.sources.orderBy("ordinal"), ["ordinal"], source),
        (']},"entidades":[', case.entities.join(nick, "id", "left"), ["ord", "id"], entity),
        ('],"vinculos":[', case.links.join(pieces, ["de", "para", "weight", "label"], "left"), ["ord", "de", "para", "weight", "label"], link),
        ('],"sugestoes_fusao":[', case.suggestions, ["a", "b"], F.to_json(F.array(named("a"), named("b"), "reason"))),
    ]
    before, after = (f'<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>{OPEN}', "</script></body></html>") if page else ("", "")
    heads = [p[0] for p in parts] + ["]}"]
    out = spark.createDataFrame([(2 * k, 0, (before if k == 0 else "") + h + (after if k == len(parts) else "")) for k, h in enumerate(heads)], "part int, place long, line string")
    for k, (_, rows, order, text) in enumerate(parts):
        line = F.replace(text, F.lit("</"), F.lit("<\\/"))
        placed = ordinals(rows.select(*order, line.alias("line")), order, "place")
        out = out.union(placed.select(F.lit(2 * k + 1), "place", F.concat(F.when(F.col("place") > 0, ",").otherwise(""), "line")))
    return out


def read(spark: SparkSession, paths: str | list[str]) -> Case:
    """The cases of documents or saved pages, a case_id for each file by its name. A page without a graph and a text that is no JSON are errors."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("case_id"), "value")
    inside = F.regexp_extract("value", rf"(?s){OPEN}(.*?)</script>", 1)
    body = F.when(~F.col("value").rlike(r"\A\s*<"), F.col("value")).when(inside != "", inside).otherwise(F.raise_error(F.concat(F.lit("no graph in the page "), "case_id")).cast("string"))
    parsed = raw.select("case_id", F.from_json(body, SCHEMA).alias("d"))
    none = F.col("d.entidades").isNull() & F.col("d.vinculos").isNull()
    d = parsed.select("case_id", F.when(none, F.raise_error(F.concat(F.lit("no graph in "), "case_id")).cast(parsed.schema["d"].dataType)).otherwise(F.col("d")).alias("d")).select("case_id", "d.*")
    theirs, weight = _map(L.KINDS.items()), _map((c, w) for w, c in CLASSES.items())
    named = lambda c: _renamed(c, theirs)
    each = lambda c: d.select("case_id", F.posexplode(c).alias("at", "x"))
    e = each("entidades")
    no = lambda c: F.coalesce(c, F.lit(False))
    entities = e.select("case_id", named("x.id").alias("id"), F.try_element_at(theirs, F.col("x.tipo")).alias("kind"), F.col("x.rotulo").alias("label"), F.coalesce("x.aliases", F.array().cast("array<string>")).alias("aliases"), no(F.col("x.revisar")).alias("review"), "x.doc", no(F.col("x.aviso")).alias("warning"), F.col("at").cast("long").alias("ord"))
    nicknames = e.select("case_id", named("x.id").alias("id"), F.explode("x.apelidos").alias("y")).select("case_id", "id", F.col("y.nome").alias("name"), F.col("y.fonte").alias("source"), "y.org")
    v = each("vinculos").select("case_id", "x", F.col("at").cast("long").alias("ord"), F.explode_outer("x.evidencias").alias("y"))
    evidence = v.select("case_id", named("x.de").alias("de"), named("x.para").alias("para"), F.try_element_at(weight, F.col("x.tipo")).alias("weight"), F.col("x.rotulo").alias("label"), F.col("y.fonte").alias("source"), F.col("y.trecho").alias("excerpt"), F.col("y.data").alias("day"), F.col("y.prec").alias("precision"), "x.n", no(F.col("x.dir")).alias("directed"), "ord")
    sources = each("meta.fontes").select("case_id", F.col("at").alias("ordinal"), F.col("x.nome").alias("source"), "x.sha256", "x.bytes")
    suggestions = each("sugestoes_fusao").select("case_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("reason")).select("case_id", named("a").alias("a"), named("b").alias("b"), "reason")
    return Case(sources, entities, evidence, relating.links(evidence), suggestions, nicknames, [])
