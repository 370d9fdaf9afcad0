"""Readers of registry files, call records, address books, dictionaries and web pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cases.lexicon import CALL_COLUMNS
from ..functions import scalars

#: Kinds of node by their name in registry files.
KINDS = {"pessoa": "person", "empresa": "company", "consorcio": "consortium", "consorcio / scp": "consortium", "telefone": "phone", "email": "email", "e-mail": "email", "endereco": "address"}


def _header(name: str) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", name.lstrip("﻿")).encode("ascii", "ignore").decode()
    return "_".join(plain.lower().split())


def table_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with ; or , as its header tells; headers in plain lower case, every column a string."""
    first = spark.read.text(path).first()
    if first is None or not first[0].strip("﻿ \t\r"):
        raise ValueError("the file is empty")
    sep = ";" if first[0].count(";") > first[0].count(",") else ","
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')
    return rows.toDF(*map(_header, rows.columns))


def key(kind: Column, name: Column) -> Column:
    """kind:name key; null for a blank name."""
    k = F.when(kind == "phone", F.coalesce(scalars.local_number(name), F.lit(""))).otherwise(scalars.name_key(name, kind.isin("company", "consortium")))
    return F.when(F.trim(name) != "", F.concat_ws(":", kind, k))


def registry(spark: SparkSession, path: str, source: str) -> DataFrame:
    """De, para, weight 3, label, source, day from a registry file of either layout.

    Layout B has a row a link (de, tipo_de, para, tipo_para, rotulo), layout A a row a company
    (empresa, socio, telefone, email, endereco). Rows all blank are skipped; an unknown kind or
    a link without both ends is an error when the rows are read.
    """
    rows = table_file(spark, path)
    col = lambda *names: F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names if n in rows.columns], F.lit(None).cast("string"))
    if {"de", "para", "tipo_de", "tipo_para"} <= set(rows.columns):
        kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
        kind = lambda c: F.coalesce(F.try_element_at(kinds, scalars.plain(F.col(c))), F.raise_error(F.concat(F.lit("unknown kind: "), F.coalesce(c, F.lit("none")))))
        end = lambda c, t: F.coalesce(key(kind(t), col(c)), F.raise_error(F.lit(f"a link without {c}")))
        rows = rows.where(F.coalesce(*[col(c) for c in rows.columns]).isNotNull())
        out = rows.select(end("de", "tipo_de").alias("de"), end("para", "tipo_para").alias("para"), F.coalesce(col("rotulo"), F.lit("link")).alias("label"), col("fonte").alias("f"), col("data").alias("d"))
    elif {"empresa", "socio"} & set(rows.columns):
        company, partner = key(F.lit("company"), col("empresa")), key(F.lit("person"), col("socio"))
        holder = F.coalesce(company, partner)
        link = lambda de, para, label: F.struct(de.alias("de"), para.alias("para"), label.alias("label"))
        owned = [link(holder, key(F.lit(k), col(c)), F.lit(k)) for k, c in (("phone", "telefone"), ("email", "email"), ("address", "endereco"))]
        made = F.array(link(partner, company, F.coalesce(col("qualificacao", "papel", "cargo", "rotulo"), F.lit("partner"))), *owned)
        out = rows.select(F.explode(made).alias("l"), col("fonte").alias("f"), col("data").alias("d")).select("l.*", "f", "d").where("de is not null and para is not null")
    else:
        raise ValueError("neither layout A (empresa, socio, ...) nor layout B (de, tipo_de, para, tipo_para, ...)")
    return out.select("de", "para", F.lit(3).alias("weight"), "label", F.coalesce("f", F.lit(source)).alias("source"), scalars.flexible_date(F.col("d"))["day"].alias("day"))


#: Forms of a call's time.
FORMS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "yyyy-M-d", "d/M/yyyy")


def timestamp(c: Column) -> Column:
    """the first form that takes the whole text."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in FORMS])


def call_records(spark: SparkSession, path: str) -> DataFrame:
    """A, b, n, seconds, first, last, night of each directed pair; bad numbers and self-calls drop out."""
    rows = table_file(spark, path)
    found = {k: next((c for c in names if c in rows.columns), None) for k, names in CALL_COLUMNS.items()}
    if not (found["a"] and found["b"]):
        raise ValueError("no columns of origin and destination")
    get = lambda k: F.col(found[k]) if found[k] else F.lit(None).cast("string")
    at = timestamp(get("at"))
    calls = rows.select(scalars.local_number(get("a")).alias("a"), scalars.local_number(get("b")).alias("b"), at.alias("at"), scalars.seconds(get("length")).alias("length")).where("a <> b")
    night = (F.hour("at") >= 22) | (F.hour("at") < 5)
    return calls.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("length").alias("seconds"), F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(night).alias("night"))


def vcards(spark: SparkSession, path: str) -> DataFrame:
    """Card (its number), name, tels, emails, org of each card; folded lines are joined, groups and parameters ignored."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n[ \t]", "")
    cards = spark.read.text(path, wholetext=True).select(F.posexplode(F.slice(F.split(text, "(?i)BEGIN:VCARD"), 2, 2**31 - 1)).alias("card", "body"))
    lines = F.split("body", "\n")
    of = lambda field: F.transform(F.filter(lines, lambda x: x.rlike(rf"(?i)^([^.:;]+\.)?{field}[;:]")), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    n = F.split(F.try_element_at(of("N"), F.lit(1)), ";")
    given = F.trim(F.concat_ws(" ", F.try_element_at(n, F.lit(2)), F.try_element_at(n, F.lit(1))))
    tels = F.filter(F.transform(of("TEL"), scalars.local_number), lambda x: x.isNotNull())
    return cards.select("card", F.coalesce(F.try_element_at(of("FN"), F.lit(1)), given).alias("name"), tels.alias("tels"), of("EMAIL").alias("emails"), F.try_element_at(of("ORG"), F.lit(1)).alias("org"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Kind, name from lines kind;name; # starts a comment."""
    parts = F.split("value", ";", 2)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = spark.read.text(path).where("value like '%;%' and not trim(value) like '#%'")
    return rows.select(F.try_element_at(kinds, scalars.plain(parts[0])).alias("kind"), F.trim(parts[1]).alias("name")).where("kind is not null and name <> ''")


class _Page(HTMLParser):
    SKIPPED = frozenset("script style nav header footer aside noscript form svg".split())
    BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li ul ol table tr blockquote main".split())

    def __init__(self):
        super().__init__()
        self.parts, self.article, self.title, self.skip, self.inside, self.heading = [], [], [], [], 0, False

    def handle_starttag(self, tag, attrs):
        self.heading = tag == "title" or self.heading and tag != "body" and tag not in self.BLOCKS
        if tag in self.SKIPPED:
            self.skip.append(tag)
        self.inside += tag == "article"
        self._add("\n" if tag == "br" else "\n\n" if tag in self.BLOCKS else "")

    def handle_endtag(self, tag):
        self.heading = self.heading and tag != "title"
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        self._add("\n\n" if tag in self.BLOCKS else "")
        self.inside -= tag == "article" and self.inside > 0

    def handle_data(self, data):
        if self.heading:
            self.title.append(data)
        else:
            self._add(data)

    def _add(self, s):
        if not self.skip:
            self.parts.append(s)
            if self.inside:
                self.article.append(s)


def _page(html: str | None) -> tuple[str, str]:
    import re

    p = _Page()
    p.feed(html or "")
    p.close()
    article = "".join(p.article).strip()
    text = article if len(article) > 300 else "".join(p.parts).strip()
    text = re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t\xa0]+", " ", text))
    return " ".join("".join(p.title).split())[:120], text


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, title, text of each page of page_id, html; a null page gives empty strings."""

    def read(frames):
        for f in frames:
            got = [_page(h) for h in f["html"]]
            yield f[["page_id"]].assign(title=[t for t, _ in got], text=[x for _, x in got])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(read, "page_id long, title string, text string")
