import random

from knotwork.llm import ngram_join as J


def brute(docs):
    def shingled(t):
        w = J.common.WORD.findall((t or "").translate(J.common.ASCII_LOWER))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {k: shingled(t) for k, t in docs.items()}
    up = {k: k for k in docs}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in docs:
        for b in docs:
            if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(s[k]), root(k)) for k in docs}


def test_components(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefé", k=r.randint(2, 4)))
    bases = [[word() for _ in range(n)] for n in (40, 60, 120)]
    docs = {0: None, 1: "", 2: " \n", 3: "a b", 4: "A b", 5: "a b c d e", 6: "a b c", 7: "a b" * 50_000}
    for i in range(8, 260):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        if i % 5 == 0:
            w = w[: r.randint(5, len(w))] + [word() for _ in range(r.randint(0, 9))]
        docs[i] = " ".join(w)
    table = spark.createDataFrame([(k, v, "x", 5) for k, v in docs.items()] + [(None, "a b", "y", 6)], "doc_id long, text string, token string, n int")
    want = brute(docs)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(table).collect()}
    assert got == want
    monkeypatch.setattr(J, "FREQUENT", 0)  # another order of shingles, the same result
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in J.jaccard_components(table).collect()} == want


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert J.jaccard_components(spark.createDataFrame([(5, "a"), (5, "a"), (9, None)], "doc_id long, text string")).count() == 2


def test_bitmaps_never_rule_out_a_link():
    r = random.Random(8)
    for _ in range(300):
        n = r.randint(1, 300)
        a = J.np.unique(J.np.array([r.getrandbits(64) for _ in range(n)], J.np.uint64))
        b = J.np.unique(J.np.r_[a[r.randint(0, n // 4) :], J.np.array([r.getrandbits(64) for _ in range(r.randint(0, n // 4))], J.np.uint64)])
        assert len(b) == 0 or J.may_link(len(a), len(b), J.sketch(a), J.sketch(b)) or not J.linked(a, b)
