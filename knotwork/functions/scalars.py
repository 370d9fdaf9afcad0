"""Scalar functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cases.lexicon import STATE_OF

#: Weights of the two check digits of a company number.
COMPANY_WEIGHTS = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def digits(c: Column) -> Column:
    """F2."""
    return F.regexp_replace(c, "[^0-9]", "")


def _check(c: Column, weights: tuple[int, ...]) -> Column:
    total = sum((F.substring(c, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def company_number_valid(c: Column) -> Column:
    """14 digits, not all equal, both check digits right."""
    first, second = _check(c, COMPANY_WEIGHTS), _check(c, (6, *COMPANY_WEIGHTS))
    right = (F.substring(c, 13, 1).cast("int") == first) & (F.substring(c, 14, 1).cast("int") == second)
    return c.rlike(r"^[0-9]{14}$") & (c != F.repeat(F.substring(c, 1, 1), 14)) & right


def person_number_valid(c: Column) -> Column:
    """masked numbers pass; else 11 digits, not all equal, both check digits right."""
    first, second = _check(c, tuple(range(10, 1, -1))), _check(c, tuple(range(11, 1, -1)))
    right = (F.substring(c, 10, 1).cast("int") == first) & (F.substring(c, 11, 1).cast("int") == second)
    return c.contains("*") | (c.rlike(r"^[0-9]{11}$") & (c != F.repeat(F.substring(c, 1, 1), 11)) & right)


def local_number(c: Column) -> Column:
    """digits without a leading 55 when 12 or 13 long; null unless 10 or 11 stay."""
    d = digits(c)
    d = F.when(F.length(d).isin(12, 13) & d.startswith("55"), F.substring(d, 3, 11)).otherwise(d)
    return F.when(F.length(d).isin(10, 11), d)


def phone(local: Column) -> Column:
    """Struct number (international), kind and state of a number in local form; null for an unknown area code or an impossible number."""
    area, rest = F.substring(local, 1, 2), F.substring(local, 3, 9)
    kind = F.when(rest.rlike("^9[0-9]{8}$"), "mobile").when(rest.rlike("^[2-5][0-9]{7}$"), "landline")
    state = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv]), area)
    return F.when(kind.isNotNull() & state.isNotNull(), F.struct(F.concat(F.lit("+55"), local).alias("number"), kind.alias("kind"), state.alias("state")))


#: Titles and short forms whose dot ends no sentence.
SHORT_FORMS = "Av|Dr|Dra|Sr|Sra|Prof|Profa|Cia|Ltd|Exmo|Exma"
#: Holds for every text with a dot that a split takes away, found at the dots alone.
HAS_SHORT_FORM = rf"\.(?<=(?:{SHORT_FORMS})\.|S\.(?=\s?A))"


def sentences(c: Column, keep_parentheses: bool = True) -> Column:
    """X1's split: after . ! or ? before a space and a capital, quote or parenthesis, or at blank lines; single newlines are spaces.

    With keep_parentheses one after a legal form's dot, as in "Ltda. (CNPJ ...)", stays with the company. F15 comes first: S.A. becomes SA. and short forms lose their dot.
    """
    start = r"(?<![\p{L}\p{N}_])"
    c = F.replace(c, F.lit("\r"), F.lit(""))
    shortened = F.regexp_replace(F.regexp_replace(c, start + r"S\.\s?A\.?", "SA."), rf"{start}({SHORT_FORMS})\.", "$1")
    # most texts hold no short form, which one look at their dots tells
    c = F.when(c.rlike(HAS_SHORT_FORM), shortened).otherwise(c)
    # c stands here once: a column that a condition names too is worked out again for each place
    flat = F.replace(F.regexp_replace(c, "\n{2,}", "\x01"), F.lit("\n"), F.lit(" "))
    start = "[A-ZÀ-Ú\"“]|(?<!(?:Ltda|LTDA|SA|S/A|ME|EPP|EIRELI|Eireli)\\. {1,9})\\(" if keep_parentheses else "[A-ZÀ-Ú\"“(]"
    marked = F.regexp_replace(flat, rf"([.!?])\s+({start})", "$1\x01$2")
    return F.filter(F.transform(F.split(marked, "\x01", -1), lambda s: F.trim(s)), lambda s: s != "")


#: Accented letters of Western European languages and their plain forms.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def plain(c: Column) -> Column:
    """accents off, other non-ASCII dropped, white space collapsed and trimmed, lower case."""
    ascii_only = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.lower(F.regexp_replace(ascii_only, r"[ \t\n\x0B\f\r]+", " ")))


def flexible_date(c: Column) -> Column:
    """struct day, precision: ISO and dd/mm/yyyy (d), yyyy-mm and mm/yyyy (m), yyyy (a); null if none is valid."""
    t = F.trim(c)
    iso, br = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.regexp_extract(t, r"^([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    ym, my, y = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2})$", 1), F.regexp_extract(t, r"^([0-9]{2}/[0-9]{4})$", 1), F.regexp_extract(t, r"^([0-9]{4})$", 1)
    at = lambda s, f: F.try_to_date(F.when(s != "", s), f)
    day, month, year = F.coalesce(at(iso, "yyyy-MM-dd"), at(br, "dd/MM/yyyy")), F.coalesce(at(ym, "yyyy-MM"), at(my, "MM/yyyy")), at(y, "yyyy")
    return F.struct(F.coalesce(day, month, year).alias("day"), F.when(day.isNotNull(), "d").when(month.isNotNull(), "m").when(year.isNotNull(), "a").alias("precision"))


def seconds(c: Column) -> Column:
    """a duration in seconds: blank or bad 0, h:m:s or m:s by the last three groups, else a number, comma or point."""
    t = F.trim(c)
    groups = F.split(t, ":")
    part = lambda i: F.coalesce(F.try_element_at(groups, F.lit(-i)).try_cast("long"), F.lit(0))
    number = F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    bounded = F.when(F.abs(number) < 1e15, number.cast("long"))
    colon = F.when(t.rlike("^[0-9]+(:[0-9]+)+$"), part(1) + part(2) * 60 + part(3) * 3600)
    return F.coalesce(F.when(t.contains(":"), colon).otherwise(bounded), F.lit(0)).cast("long")


#: Words of legal form that a company's name key leaves out.
LEGAL_FORMS = "ltda|sa|s\\.a\\.?|s/a|me|epp|eireli|cia|inc|llc|gmbh"


def name_key(c: Column, is_company: Column) -> Column:
    """plain name without legal forms for companies, av and r at the start spelled out, only a-z 0-9 @ . and spaces kept."""
    p = plain(c)
    p = F.when(is_company, F.regexp_replace(p, rf"(^|(?<=[ ,]))({LEGAL_FORMS})\.?(?=$|[ ,])", "")).otherwise(p)
    p = F.regexp_replace(F.regexp_replace(p, r"^av\.? ", "avenida "), r"^r\.? ", "rua ")
    return F.trim(F.regexp_replace(F.regexp_replace(p, "[^a-z0-9@. ]", ""), " +", " "))
