import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from knotwork.llm import common, sorted_runs, substring_dedup, suffix_dedup


def brute(units, width):
    """Which units of each document a repeated window covers."""
    seen = Counter(tuple(u[i : i + width]) for u in units.values() for i in range(len(u) - width + 1))
    out = {}
    for k, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[tuple(u[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[k] = gone
    return out


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdéf", k=r.randint(1, 7)))
    passage = " ".join(word() for _ in range(120))
    docs = {0: passage, 1: passage, 2: None, 3: "", 4: "a", 5: "x y " * 300, 6: passage[:399], 7: passage[3:500]}
    for i in range(8, 60):
        a, n = r.randint(0, 400), r.randint(100, 450)
        mid = passage[a : a + n]
        if i % 3 == 0:  # a word changed
            mid = mid[: n // 2] + "Z" + mid[n // 2 + 1 :]
        docs[i] = " ".join([word() for _ in range(r.randint(0, 60))] + [mid] + [word() for _ in range(r.randint(0, 60))])
    return docs


def table(spark, docs):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in docs.items()] + [(None, docs[0], "x", 1)], "doc_id long, text string, core string, pos int")


def test_bytes(spark):
    docs = fixture()
    want = brute({k: list((v or "").encode()) for k, v in docs.items()}, 400)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(table(spark, docs)).collect()}
    assert sorted(got) == sorted(docs) and sum(map(sum, want.values())) > 1000
    for k, gone in want.items():
        raw = (docs[k] or "").encode()
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (len(raw), sum(gone), kept), k
        assert got[k].n_spans == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)) and got[k].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_words(spark):
    docs = fixture()
    units = {k: common.WORD.findall(v or "") for k, v in docs.items()}
    want = brute(units, 35)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, docs)).collect()}
    assert sorted(got) == sorted(docs) and sum(map(sum, want.values())) > 500
    for k, gone in want.items():
        assert (got[k].n_words, got[k].n_removed, got[k].kept) == (len(gone), sum(gone), " ".join(w for w, g in zip(units[k], gone) if not g)), k


@pytest.mark.parametrize("operator", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_small_tables(spark, operator):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert operator(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (2, "a b")], "doc_id long, text string")
    assert sorted(r.doc_id for r in operator(twice).collect()) == [1, 2]


def test_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(sorted_runs, "PIVOT_ROWS", 50)
    r = np.random.default_rng(1)
    columns = [r.integers(0, k, 3000) for k in (3, 40, 1000)]
    at = sorted_runs.multikey_quicksort(columns)
    assert (at == np.lexsort(columns[::-1])).all() or all((c[at] == c[np.lexsort(columns[::-1])]).all() for c in columns)


def test_bucket_of_equals_comparing_rows():
    r = np.random.default_rng(2)
    rows, cuts = (np.array(sorted(map(tuple, r.integers(0, 4, (n, 3))))) for n in (400, 30))
    got = sorted_runs.bucket_of(list(rows.T), list(cuts.T))
    assert got.tolist() == [sum(tuple(c) <= tuple(x) for c in cuts) for x in rows]
    assert sorted_runs.bucket_of(list(rows.T), [np.zeros(0, np.int64)] * 3).tolist() == [0] * 400


def test_runs_across_given_buckets(spark):
    """One key over all buckets, some of them empty."""
    rows = spark.range(3000).selectExpr("if(id < 2500, 7L, id) core", "if(id < 2000, 1L, id) around", "id doc_id", "0L pos", "cast(if(id < 2900, id div 400 * 2, 15) as int) bucket")
    got = sorted_runs.repeated(rows, ["core", "around"], ["doc_id", "pos"], 16).collect()
    assert len(got) == 2500 and sum(r.twin for r in got) == 2000 and sum(r["head"] for r in got) == 501


def test_runs_across_buckets(spark):
    rows = spark.range(3000).selectExpr("if(id < 2500, 7, id) core", "if(id < 2000, 1, id) around", "id doc_id", "0L pos")
    got = sorted_runs.repeated(rows.selectExpr("cast(core as long) core", "cast(around as long) around", "doc_id", "cast(pos as long) pos"), ["core", "around"], ["doc_id", "pos"], 4).collect()
    assert len(got) == 2500 and sum(r.twin for r in got) == 2000 and sum(r["head"] for r in got) == 501
