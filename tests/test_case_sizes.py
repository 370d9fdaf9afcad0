"""Steps of the case builder that took too long over many reports."""

from itertools import combinations

import numpy as np
import pytest

from knotwork.cases import building, reading, relating, resolving


def test_variants_travel_packed_and_meet_in_buckets(spark, monkeypatch):
    for name, value in (("BUCKET", 600), ("HELD", 500), ("MADE", 100)):
        monkeypatch.setattr(resolving, name, value)
    sent, shared = [], resolving._variants
    monkeypatch.setattr(resolving, "_variants", lambda buckets: (sent.append(buckets), shared(buckets))[1])
    words = ("brax", "clem", "dosk", "fint")
    names = [f"nil {a}brax {b}clem gulp{c}" for a in words for b in words for c in words]
    names += [n.replace("brax", "brix") for n in names[::7]] + [n + "s" for n in names[3::9]] + ["aaaaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaaac"]
    rows = [(case, "person", k, i, i % 11 == 10) for case in "cd" for i, k in enumerate(names) if case == "c" or i % 2]
    got = {(r.case_id, r.key): r.parent for r in resolving.spellings(spark.createDataFrame(rows, "case_id string, kind string, key string, first long, documented boolean")).collect()}
    like = lambda new, old: resolving.SequenceMatcher(None, new, old).ratio() >= 0.94 and (new[0] == old[0] or new[-1] == old[-1])
    want = {}
    for case, _, new, first, documented in rows:
        old = next((k for c, _, k, i, _ in rows if c == case and i < first and like(new, k)), None)
        if old and not documented:
            want[case, new] = old
    assert got == want and len(want) > 10
    assert sent[0] > 4  # more buckets than partitions: a bucket's size is bounded


@pytest.mark.parametrize(("key", "common"), [("nil brax", 6), ("aab", 2), ("abc", 3)])
def test_equal_subsequences_have_equal_hashes(key, common):
    hashes = resolving._hashed([key, "x" * len(key)], np.array([5, 5], np.uint64), common)[0]
    made = ["".join(key[i] for i in range(len(key)) if i not in gone) for gone in combinations(range(len(key)), len(key) - common)]
    assert len(hashes) == len(made) and len(set(zip(hashes.tolist(), made))) == len(set(made)) == len(set(hashes.tolist()))


def test_sentences_are_read_in_many_tasks(spark):
    one = spark.createDataFrame([("c", i, f"r{i}", f"Nil Brax Clem {i} é sócia da Gulp Fint Ltda.") for i in range(40)], "case_id string, src int, source string, text string").coalesce(1)
    read = reading.read(one)
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert read.count() == 40


def test_tables_that_nobody_asks_for_are_not_made(spark, monkeypatch):
    made = []
    for name in ("links", "close"):
        monkeypatch.setattr(relating, name, lambda df, name=name, f=getattr(relating, name): (made.append(name), f(df))[1])
    texts = spark.createDataFrame([("c", 0, "r", "Nil Brax Clem é sócia da Gulp Fint Ltda.")], "case_id string, src int, source string, text string")
    case = building.build(spark, [], texts)
    assert case.entities.count() == 2 and made == []
    assert case.links.count() == 1 and case.evidence.count() == 1 and case.links is case.links and sorted(made) == ["close", "links"]
    with pytest.raises(AttributeError):
        case.no_such_table
