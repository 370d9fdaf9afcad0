import random

import duckdb
import pandas as pd
import pytest

from knotwork.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def made(r: random.Random) -> list[tuple]:
    """Conversations that share beginnings, with gaps, ties, nulls, repeated rows, a long one and many copies."""
    rows = []
    for c in r.sample(range(-12, 60), 45):
        n = r.choice([1, 2, 3, 5, 9, 14])
        for t in range(n):
            rows.append((c, r.choice([t, t, t, 2 * t, None]), r.choice(["user", "bot", None]), r.choice(["a", "b", "", None, "ç"]), 1, "x"))
    rows += [(c, t, "user", f"copy {t}", 1, "x") for c in range(100, 200) for t in range(4)]
    rows += [(7, 1000 + t, "user", str(t % 3), 1, "x") for t in range(160)] + [(8, 1000 + t, "user", str(t % 3), 1, "x") for t in range(120)]
    return rows + [rows[0], rows[0], (None, 1, "user", "lost", 1, "x"), (300, 0, "user", "long " * 50_000, 1, "x"), (305, 0, None, None, 1, "x")]


def both(spark, rows):
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "depth", "owner"], dtype=object).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("given", table)
    con.execute("create view conversations as select conv_id::bigint conv_id, turn::bigint turn, role::varchar as role, text::varchar as text from given")
    got = ct.trie(*ct.rebuilt(ct.turns(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    want = con.execute(ct.SQL)
    names = [d[0] for d in want.description]
    return sorted(map(repr, (tuple(x[n] for n in names) for x in got.collect()))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("piece", [4096, 7])
def test_trie_equals_sql(spark, monkeypatch, piece):
    monkeypatch.setattr(ct, "PIECE", piece)
    got, want = both(spark, made(random.Random(piece)))
    assert got == want and len(got) > 300


def test_empty_and_turnless(spark):
    assert ct.trie(*ct.rebuilt(ct.turns(spark.createDataFrame([], SCHEMA)))).count() == 0
    # crc32 of each of these is above 1 modulo 9 and their base is absent, so none keeps its only turn
    got, want = both(spark, [(c, 0, "user", "hi", 1, "x") for c in range(1, 40) if c % 5])
    assert got == want
    assert ct.trie(*ct.rebuilt(ct.turns(spark.createDataFrame([(11, 0, "user", "hi", 1, "x")], SCHEMA)))).count() >= 1
