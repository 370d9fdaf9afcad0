"""Registers, call records and address books as mentions and evidence: S3 to S8, A1."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import scalars
from ..sources import importers
from . import lexicon as L
from .reading import DOC, PHASE, check_digits, name_keys, phone_of, phones_in, place

PHONE = StructType([StructField("number", StringType()), StructField("label", StringType())])


class Imported(NamedTuple):
    mentions: DataFrame  # case_id, ord, source, kind, label, number, key, doc, high
    links: DataFrame  # case_id, de_ord, para_ord, weight, label, source, excerpt, day, precision, n, directed, ord


def _pairs(found: list) -> pd.DataFrame:
    return pd.DataFrame([x or (None, None) for x in found], columns=["number", "label"])


@F.pandas_udf(PHONE)
def register_phone(text: pd.Series) -> pd.DataFrame:
    """The first phone in a register's cell, which may lack its parentheses."""
    shaped = (x if x is None or "(" in x or "+" in x else f"({x[:2]}) {x[2:]}" for x in text)
    return _pairs([next((p[1:] for p in phones_in(x)), None) if x else None for x in shaped])


def _normal(text: str) -> tuple[str, str] | None:
    d = re.sub(r"\D", "", text)
    d = d[2:] if len(d) in (12, 13) and d.startswith("55") else d
    return phone_of(d[:2], d[2:]) if len(d) in (10, 11) else None


@F.pandas_udf(PHONE)
def any_phone(text: pd.Series) -> pd.DataFrame:
    """a phone number in any form."""
    return _pairs([_normal(x) if x else None for x in text])


@F.pandas_udf(BooleanType())
def document_valid(digits: pd.Series, company: pd.Series) -> pd.Series:
    return pd.Series([bool(c is False and "*" in (d or "")) or check_digits(d or "", bool(c)) for d, c in zip(digits, company)], dtype=bool)


def _get(rows: DataFrame):
    """The first of some columns that isn't blank, trimmed."""
    return lambda *names: F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names if n in rows.columns], F.lit(None).cast("string"))


def _error(line, text) -> Column:
    return F.raise_error(F.concat(F.lit("line "), line.cast("string"), F.lit(": "), text if isinstance(text, Column) else F.lit(text)))


def register(spark: SparkSession, case_id: str, path: str, source: str) -> Imported:
    """S3 to S5. Layout B has a row a link, layout A a row a company; rows that can't be used are errors that name their line, as rows are read."""
    rows = importers.table_file(spark, path)
    col, columns = _get(rows), rows.columns
    line = F.monotonically_increasing_id() % (1 << 33) + 2  # a file is one task: its rows are in order; line 1 is the header
    rows = rows.withColumn("line", line).where(F.coalesce(*[col(c) for c in columns]).isNotNull())
    end = lambda label, kind, doc: F.struct(label.alias("label"), kind.alias("kind"), doc.alias("doc"))
    link = lambda a, b, label: F.struct(a.alias("a"), b.alias("b"), label.alias("label"))
    if {"de", "para", "tipo_de", "tipo_para"} <= set(columns):
        both = col("de").isNotNull() & col("para").isNotNull()
        made = F.array(F.when(both, link(end(col("de"), col("tipo_de"), col("doc_de")), end(col("para"), col("tipo_para"), col("doc_para")), F.coalesce(col("rotulo"), F.lit(L.REGISTERED)))).otherwise(_error(F.col("line"), "a link needs 'de' and 'para'")))
    elif {"empresa", "socio"} & set(columns):
        company, partner = end(col("empresa"), F.lit("empresa"), col("cnpj")), end(col("socio"), F.lit("pessoa"), col("cpf"))
        holder = F.when(col("empresa").isNotNull(), company).when(col("socio").isNotNull(), partner).otherwise(_error(F.col("line"), "neither 'empresa' nor 'socio'"))
        links = [F.when(col("empresa").isNotNull() & col("socio").isNotNull(), link(partner, company, F.coalesce(col(*L.LABEL_COLUMNS), F.lit(L.OFFICIAL_PARTNER))))]
        for c, label in (("telefone", L.USES["phone"]), ("email", L.USES["email"]), ("endereco", L.SEAT)):
            links.append(F.when(col(c).isNotNull(), link(holder, end(col(c), F.lit(c), F.lit(None).cast("string")), F.lit(label))))
        made = F.array_compact(F.array(*links))
        made = F.when(F.size(made) > 0, made).otherwise(_error(F.col("line"), "nothing to link: add socio, telefone, email or endereco"))
    else:
        raise ValueError(f"neither layout A (empresa, cnpj, socio, ...) nor layout B (de, tipo_de, para, tipo_para, ...): {', '.join(columns) or 'no columns'}")
    each = rows.select("line", F.coalesce(col("fonte"), F.lit(source)).alias("from"), scalars.flexible_date(col("data")).alias("d"), F.posexplode(made).alias("k", "l"))
    kinds = F.create_map(*[F.lit(x) for kv in L.KINDS.items() for x in kv])
    ends = each.select("line", "k", F.posexplode(F.array("l.a", "l.b")).alias("side", "e"))
    named = F.replace(scalars.plain(F.col("e.kind")), F.lit("consorcio / scp"), F.lit("consorcio"))
    ends = ends.withColumn("kind", F.coalesce(F.try_element_at(kinds, named), _error(F.col("line"), F.concat(F.lit("unknown kind "), F.coalesce("e.kind", F.lit("none"))))))
    ends = ends.withColumn("phone", register_phone(F.when(F.col("kind") == "phone", F.col("e.label"))))
    digits, is_company = F.regexp_replace("e.doc", r"[^\d*]", ""), F.col("kind") == "company"
    doc = F.when(F.col("e.doc").isNotNull() & F.col("kind").isin("company", "person"), F.struct(F.when(is_company, "cnpj").otherwise("cpf").alias("kind"), digits.alias("key"), F.col("e.doc").alias("text"), document_valid(digits, is_company).alias("valid")))
    label = F.when(F.col("kind") == "phone", F.coalesce("phone.label", _error(F.col("line"), F.concat(F.lit("no phone number: "), F.col("e.label"))))).otherwise(F.col("e.label"))
    ord_ = lambda k, side: place(1, F.col("line"), 0, k * 2 + side)
    mentions = ends.select(F.lit(case_id).alias("case_id"), ord_(F.col("k"), F.col("side")).alias("ord"), F.lit(source).alias("source"), "kind", label.alias("label"), F.col("phone.number").alias("number"), doc.cast(DOC).alias("doc"), F.lit(True).alias("high"))
    links = each.select(
        F.lit(case_id).alias("case_id"), ord_(F.col("k"), F.lit(0)).alias("de_ord"), ord_(F.col("k"), F.lit(1)).alias("para_ord"), F.lit(3).alias("weight"), F.col("l.label").alias("label"), F.col("from").alias("source"),
        F.substring(F.concat_ws(" — ", "l.a.label", "l.b.label"), 1, L.EXCERPT).alias("excerpt"), F.col("d.day").cast("string").alias("day"), F.col("d.precision").alias("precision"),
        F.lit(None).cast("long").alias("n"), F.lit(False).alias("directed"), ord_(F.col("k"), F.lit(0)).alias("ord"),
    )
    return Imported(mentions.withColumn("key", name_keys("label", "kind")), links)


def calls(spark: SparkSession, case_id: str, path: str, source: str) -> tuple[Imported, DataFrame]:
    """An official link for each directed pair of numbers, and one row of counts: case_id, source, lines, ignored, pairs."""
    rows = importers.table_file(spark, path)
    found = {k: next((c for c in names if c in rows.columns), None) for k, names in L.CALL_COLUMNS.items()}
    if not (found["a"] and found["b"]):
        raise ValueError("call records need columns of origin and destination: 'origem' and 'destino' (and data, duracao)")
    get = lambda k: F.col(found[k]) if found[k] else F.lit(None).cast("string")
    each = rows.select(any_phone(get("a")).alias("a"), any_phone(get("b")).alias("b"), importers.timestamp(get("at")).alias("at"), scalars.seconds(get("length")).alias("seconds"))
    good = each.where("a.number <> b.number")
    night = (F.hour("at") >= 22) | (F.hour("at") < 5)
    sums = good.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(night).alias("night"))
    short = lambda c: F.regexp_replace(F.col(c), r"\s*\[.*?\]", "")
    length = F.format_string("; duração total %dh%02dmin%02ds", (F.col("seconds") / 3600).cast("long"), (F.col("seconds") % 3600 / 60).cast("long"), F.col("seconds") % 60)
    span = F.concat(F.lit("; de "), F.date_format("first", "dd/MM/yyyy"), F.lit(" a "), F.date_format("last", "dd/MM/yyyy"))
    excerpt = F.concat(
        F.col("n").cast("string"), F.lit(" chamada(s) de "), short("a.label"), F.lit(" para "), short("b.label"), F.when(F.col("seconds") > 0, length).otherwise(""), F.coalesce(span, F.lit("")), F.when(F.col("night") > 0, F.concat(F.lit("; "), F.col("night").cast("string"), F.lit(" entre 22h e 5h"))).otherwise("")
    )
    # a number in international form is a place of its own: no two numbers share one, and the order of calls tells nothing
    code = lambda c: F.substring(f"{c}.number", 2, 20).cast("long") + 2 * PHASE
    sides = sums.select(F.explode(F.array("a", "b")).alias("p")).distinct()
    mentions = sides.select(F.lit(case_id).alias("case_id"), code("p").alias("ord"), F.lit(source).alias("source"), F.lit("phone").alias("kind"), F.col("p.label").alias("label"), F.col("p.number").alias("number"), F.lit(None).cast(DOC).alias("doc"), F.lit(True).alias("high"))
    links = sums.select(
        F.lit(case_id).alias("case_id"), code("a").alias("de_ord"), code("b").alias("para_ord"), F.lit(3).alias("weight"), F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " ligação").otherwise(" ligações")).alias("label"), F.lit(source).alias("source"),
        F.substring(excerpt, 1, L.EXCERPT).alias("excerpt"), F.to_date("first").cast("string").alias("day"), F.when(F.col("first").isNotNull(), "d").alias("precision"), "n", F.lit(True).alias("directed"), F.lit(2 * PHASE).cast("long").alias("ord"),
    )
    counts = each.agg(F.count("*").alias("lines"), F.count_if(~F.coalesce(F.col("a.number") != F.col("b.number"), F.lit(False))).alias("ignored"), F.countDistinct(F.when(F.col("a.number") != F.col("b.number"), F.struct("a.number", "b.number"))).alias("pairs"))
    return Imported(mentions.withColumn("key", name_keys("label", "kind")), links), counts.select(F.lit(case_id).alias("case_id"), F.lit(source).alias("source"), "lines", "ignored", "pairs")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """Card, name, tels, emails, org of a vCard file or a CSV with a name and a phone column."""
    if spark.read.text(path).where("upper(value) like '%BEGIN:VCARD%'").limit(1).count():
        return importers.vcards(spark, path).select("card", "name", "tels", F.transform("emails", lambda e: F.lower(e)).alias("emails"), "org")
    rows = importers.table_file(spark, path)
    found = {k: next((c for c in names if c in rows.columns), None) for k, names in L.CARD_COLUMNS.items()}
    if not (found["name"] and found["tels"]):
        raise ValueError("an address book is a vCard file or a CSV with the columns 'nome' and 'telefone'")
    get = lambda k: F.coalesce(F.trim(found[k]), F.lit("")) if found[k] else F.lit("")
    some = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.monotonically_increasing_id().alias("card"), get("name").alias("name"), some(F.split(get("tels"), "[;|]")).alias("tels"), some(F.array(F.lower(get("emails")))).alias("emails"), get("org").alias("org"))


class Book(NamedTuple):
    mentions: DataFrame
    saved: DataFrame  # case_id, ord (of the number or address), owner_ord, name, org, source, excerpt, place
    counts: DataFrame  # case_id, source, owner, cards, numbers, ignored


def book(spark: SparkSession, case_id: str, path: str, source: str, owner: str | None, number: int, limit: int = 5000) -> Book:
    """An owner's address book; the first ``limit`` cards count. number: the book's place among the case's."""
    c = cards(spark, path).where(F.col("card") % (1 << 33) < limit).withColumn("card", (F.col("card") % (1 << 33)).cast("long"))
    tels = c.select("card", "name", "org", F.posexplode(F.transform("tels", lambda t: t)).alias("i", "t")).withColumn("p", any_phone("t"))
    good = tels.where("p.number is not null").select("card", "name", "org", F.lit("phone").alias("kind"), F.col("i").alias("i"), F.col("p.label").alias("label"), F.col("p.number").alias("number"))
    mails = c.select("card", "name", "org", F.posexplode("emails").alias("i", "label")).where("label like '%@%'").select("card", "name", "org", F.lit("email").alias("kind"), (F.col("i") + 1024).alias("i"), "label", F.lit(None).cast("string").alias("number"))
    ord_ = place(3, number, F.col("card") + 1, F.col("i"))
    items = good.union(mails).withColumn("ord", ord_)
    shown = F.when(F.col("kind") == "phone", F.when(F.trim("name") == "", "(sem nome)").otherwise(F.col("name"))).otherwise(F.when(F.trim("name") == "", F.col("label")).otherwise(F.col("name")))
    excerpt = F.concat(F.lit("salvo como «"), shown, F.lit("»"), F.when((F.col("kind") == "phone") & (F.coalesce(F.col("org"), F.lit("")) != ""), F.concat(F.lit(" ("), F.col("org"), F.lit(")"))).otherwise(""))
    empty = F.lit(None).cast(DOC).alias("doc")
    mentions = items.select(F.lit(case_id).alias("case_id"), "ord", F.lit(source).alias("source"), "kind", "label", "number", empty, F.lit(True).alias("high"))
    owner_ord = place(3, number, 0, 0)
    if owner:
        mentions = mentions.union(spark.range(1).select(F.lit(case_id), owner_ord, F.lit(source), F.lit("person"), F.lit(owner), F.lit(None).cast("string"), empty, F.lit(True)))
    saved = items.select(F.lit(case_id).alias("case_id"), "ord", (owner_ord if owner else F.lit(None)).cast("long").alias("owner_ord"), F.coalesce("name", F.lit("")).alias("name"), F.when(F.coalesce(F.col("org"), F.lit("")) != "", F.col("org")).alias("org"), F.lit(source).alias("source"), excerpt.alias("excerpt"), F.lit(owner).cast("string").alias("owner"), "kind")
    counts = c.agg(F.count("*").alias("cards")).crossJoin(tels.agg(F.count("p.number").alias("numbers"), (F.count("*") - F.count("p.number")).alias("ignored")))  # one row each
    return Book(mentions.withColumn("key", name_keys("label", "kind")), saved, counts.select(F.lit(case_id).alias("case_id"), F.lit(source).alias("source"), F.lit(owner or "").alias("owner"), "cards", "numbers", "ignored"))
