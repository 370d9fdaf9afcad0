"""From reports to mentions: who and what a sentence names, and where."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

_CAP = r"[A-ZÀ-Ú][\wà-ú&'-]*"
_LINK = r"(?:d[aeo]s?|e)"
#: Patterns by kind, in order of precedence; all but person are structural (high confidence).
PATTERNS = {
    "company_number": r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b",
    "person_number": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "email": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "phone": r"(?:\+55 ?)?\(\d{2}\) ?9?\d{4}-?\d{4}\b|\+55 ?\d{2} ?9?\d{4}-?\d{4}\b|\b\d{2} 9?\d{4}-\d{4}\b",
    "address": rf"\b(?:Rua|Avenida|Av\.?|Travessa|Alameda|Praça|Rodovia|Estrada) {_CAP}(?: (?:{_LINK} )?{_CAP}){{0,5}}(?:, ?(?:n[ºo°]? ?)?\d+)?",
    "consortium": rf"\bConsórcio {_CAP}(?: (?:{_LINK} )?{_CAP}){{0,4}}",
    "company": rf"\b{_CAP}(?: (?:(?:{_LINK}|&) )?{_CAP}){{0,5}} (?:Ltda|LTDA|S\.?A|S/A|ME|EPP|EIRELI|Eireli)\b\.?",
    "person": rf"\b{_CAP}(?: (?:{_LINK} )?{_CAP}){{1,4}}",
}
#: What a match can't be without, one of them: a pattern whose words a sentence doesn't hold isn't tried on it.
NEEDED = {
    "company_number": ("/",),
    "person_number": ("-",),
    "email": ("@",),
    "phone": ("-", "(", "+55"),
    "address": ("Rua ", "Avenida ", "Av ", "Av. ", "Travessa ", "Alameda ", "Praça ", "Rodovia ", "Estrada "),
    "consortium": ("Consórcio ",),
    "company": (" Ltda", " LTDA", " S.A", " SA", " S/A", " ME", " EPP", " EIRELI", " Eireli"),
    "person": (" ",),
}
#: Words cut off the start of a name, and first words no person's name has.
LEADING = frozenset("O A Os As Um Uma Em No Na Segundo Para".split())
NO_PERSON = frozenset("Ministério Secretaria Prefeitura Governo Tribunal Polícia Banco Universidade Rio São Santa Grupo Consórcio Rua Avenida".split())
OWNERS, IDENTIFIERS = ("person", "company", "consortium"), ("email", "phone", "address")
LONGEST = 1_500


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent, s of doc_id, text; a sentence is at most 1,500 characters, cut at a space where there is one."""
    cut = F.flatten(F.transform(scalars.sentences(F.col("text")), lambda s: F.regexp_extract_all(s, F.lit(rf"(?s).{{1,{LONGEST}}}(?= |$)|.{{1,{LONGEST}}}"), F.lit(0))))
    return docs.select("doc_id", F.posexplode(cut).alias("sent", "s")).where("trim(s) <> ''")


#: Signs of a mention, wider than PATTERNS: a number's digits, or two words of which both begin with a capital (streets and legal forms do, too).
_DIGIT = r"[0-9\x80-\x{10FFFF}]"
_NUMBER = rf"(?s){_DIGIT}(?:{_DIGIT}{{3}}.?{_DIGIT}{{4}}|/{_DIGIT}{{4}}-|\.{_DIGIT}{{3}}-)"
_NAME = r"[A-ZÀ-Ú][A-Za-z0-9_&'\-\x80-\x{10FFFF}]*[ \n](?:(?:d[aeo]s?|e|&)[ \n])?[A-ZÀ-Ú]"


def may_name(s: Column) -> Column:
    """Whether a sentence, or a text with one, holds a sign of a mention; none without one has any of PATTERNS. Dots and carriage returns that a split takes away count as signs."""
    return F.contains(s, F.lit("@")) | F.contains(s, F.lit("\r")) | s.rlike(_NUMBER) | s.rlike(_NAME) | s.rlike(scalars.HAS_SHORT_FORM)


def telling_sentences(docs: DataFrame) -> DataFrame:
    """sentences() without those that can't name anything; most texts aren't even split."""
    return sentences(docs.where(may_name(F.col("text")))).where(may_name(F.col("s")))


def find(s: str, words: re.Pattern | None, kinds: dict[str, str], compiled: dict) -> list[tuple]:
    """(pos, end, kind, text, high) in one sentence; what an earlier kind took is blanked with as many spaces."""
    out = []

    def take(m, kind, high):
        nonlocal s
        text = m.group()
        while kind in OWNERS and " " in text and text.split()[0] in LEADING:
            text = text.split(" ", 1)[1]
        if kind != "person" or " " in text and text.split()[0] not in NO_PERSON:
            out.append((m.end() - len(text), m.end(), kind, text, high))
            s = s[: m.start()] + " " * (m.end() - m.start()) + s[m.end() :]

    for kind, pattern in compiled.items():
        if kind == "email" and words:  # the caller's dictionary goes right after documents
            for m in list(words.finditer(s)):
                take(m, kinds[m.group().lower()], True)
        for word in NEEDED[kind]:
            if word in s:
                for m in list(pattern.finditer(s)):
                    take(m, kind, kind != "person")
                break
    return sorted(out)


def mentions(sents: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    """doc_id, sent, pos, end, kind, text, high, id. dictionary: name to kind."""
    names = {n.lower(): k for n, k in (dictionary or {}).items()}

    def run(frames):
        compiled = {k: re.compile(p) for k, p in PATTERNS.items()}
        words = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")\b") if names else None
        for f in frames:
            rows = [(d, n, *m) for d, n, s in zip(f["doc_id"], f["sent"], f["s"]) for m in find(s, words, names, compiled)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "sent", "pos", "end", "kind", "text", "high"])

    found = sents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent").cast("int").alias("sent"), "s").mapInPandas(run, "doc_id long, sent int, pos int, end int, kind string, text string, high boolean")
    key = F.when(F.col("kind") == "phone", F.coalesce(scalars.local_number(F.col("text")), scalars.digits(F.col("text"))))
    key = key.when(F.col("kind").endswith("_number"), scalars.digits(F.col("text"))).otherwise(scalars.name_key(F.col("text"), F.col("kind").isin("company", "consortium")))
    return found.withColumn("id", F.concat_ws(":", "kind", key))


def attach_numbers(found: DataFrame, reach: int = 90) -> DataFrame:
    """doc_id, sent, number, owner: each number's nearest company or person within ``reach`` characters, each owner once."""
    numbers = found.where(F.col("kind").endswith("_number")).select("doc_id", "sent", F.col("pos").alias("at"), F.col("id").alias("number"), F.when(F.col("kind") == "person_number", "person").otherwise("company").alias("wants"))
    owners = found.where(F.col("kind").isin(*OWNERS)).select("doc_id", "sent", "pos", F.col("id").alias("owner"), F.when(F.col("kind") == "person", "person").otherwise("company").alias("wants"))
    pairs = numbers.join(owners, ["doc_id", "sent", "wants"]).withColumn("far", F.abs(F.col("at") - F.col("pos"))).where(F.col("far") < reach)
    by = lambda *c: Window.partitionBy("doc_id", "sent", *c).orderBy("far", "pos", "at")
    best = pairs.withColumn("r", F.row_number().over(by("number", "at"))).where("r = 1").withColumn("r", F.row_number().over(by("owner"))).where("r = 1")
    return best.select("doc_id", "sent", "number", "owner")


def entities(found: DataFrame) -> DataFrame:
    """Id, kind, label (the longest), sources, review: low confidence in one source only."""
    totals = found.groupBy("id", "kind").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("label"), F.countDistinct("doc_id").alias("sources"), F.max("high").alias("high"))
    return totals.select("id", "kind", "label", "sources", (~F.col("high") & (F.col("sources") < 2)).alias("review"))


def merge_suggestions(known: DataFrame) -> DataFrame:
    """A, b: one name's words all among the other's; persons with the same first and last word, organisations with two words or more. Never merged by themselves."""
    from ..cases.resolving import alike_names

    key = F.substring_index("id", ":", -1)
    keys = known.select(F.lit("").alias("case_id"), "kind", key.alias("key"), F.lit(0).cast("long").alias("first"), F.lit(False).alias("documented"), key.alias("root"), "id")
    return alike_names(keys).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
