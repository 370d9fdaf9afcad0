import random
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from knotwork.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def both(spark, rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame([r[1:4] for r in rows], columns=["text", "lang", "source"], dtype=object))
    con.execute("create view documents as select text::varchar as text, lang::varchar as lang, source::varchar as source from given")
    got = sd.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = con.execute(sd.SQL)
    names = [d[0] for d in want.description]
    return sorted(repr(tuple(x[n] for n in names)) for x in got.collect()), sorted(map(repr, want.fetchall()))


def test_divergence_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(sd, "HELD", 300)
    r = random.Random(3)
    words = ["the", "The", "É", "é", "été", "naïve", "x1y", "zeta", "漢字", "a_b", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(r.choice([i, i, None, 1]), r.choice([" ".join(r.choices(words[: r.randint(3, 36)], k=r.randint(0, 60))), "", None]), r.choice(["en", "en", "en", "fr", None]), r.choice(["hot", "hot", "hot", "a", "b", "", None]), "x", 1) for i in range(400)]
    rows += [(900, "seldom words only", "de", s, "x", 1) for s in ("a", "b")] + [(901, "alone", "it", "a", "x", 1), (902, "the zeta " * 50_000, "en", "a", "x", 1), (903, None, "en", "wordless", "x", 1)]
    got, want = both(spark, rows)
    assert got == want and len(got) > 50
    assert sd.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (5, 7, 3), (10**13, 10**13, 10**8), (123_456_789_012, 9 * 10**14, 10**7), (10**15 - 3, 10**15, 1)]
    got = spark.createDataFrame(cases, "c long, t long, v long").select(sd.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


def test_radix_top_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(sd, "FEW", 4)
    monkeypatch.setattr(sd, "BITS", 5)
    r = random.Random(8)
    items = ["".join(r.choices("abé漢", k=n)) for n in range(1, 9) for _ in range(60)]
    rows = {("en", s, i): r.choice([0, 7, 7, 7, 7, r.randint(0, 5000)]) for s in ("p", "q", "tiny") for i in (items if s != "tiny" else items[:6])}
    rows |= {("fr", "equal", f"same{'a' * k}"): 3 for k in range(40)}
    got = sd.radix_top(spark.createDataFrame([(*k, v) for k, v in rows.items()], "lang string, source string, item string, value long"), 10)
    groups = defaultdict(list)
    for (lang, source, item), v in rows.items():
        groups[lang, source].append((-v, item.encode(), item, v))
    want = {(*g, item, v, k) for g, of in groups.items() for k, (_, _, item, v) in enumerate(sorted(of)[:10], 1)}
    assert {tuple(x) for x in got.collect()} == want
