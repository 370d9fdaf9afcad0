import random
import zlib

from knotwork.llm import toxicity


def test_table(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8)))
    docs, labels = [(0, None), (1, ""), (2, "x")], []
    for i in range(3, 600):
        toxic = i % 5 == 0
        words = [word() for _ in range(40)] + ([r.choice(["idiot", "scum", "moron", "zzqux" + word()]) for _ in range(3)] if toxic else [])
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(toxic)))
    table = spark.createDataFrame([(*d, "en", None) for d in docs] + [(None, "idiot", "en", 1.0)], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (9_999, 1), (0, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    got = {x.doc_id: x.score for x in toxicity.scores(table, model).collect()}
    assert sorted(got) == [d for d, _ in docs] and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] < 0.5
    wrong = sum((got[i] >= 0.5) != (i % 5 == 0) for i, _ in docs[3:])
    assert wrong < 12, wrong
    only = toxicity.fit(table, marks.limit(0))
    assert only[0]["idiot$"] > 0 and toxicity.scores(table.limit(0), only).count() == 0


def test_same_insults_in_every_toxic_row():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    for n, every in ((30, 2), (60, 6), (200, 10)):
        rows = [(" ".join({*(word() for _ in range(20)), *("you are a stupid idiot moron loser".split() if i % every == 0 else ())}), [0, 0], int(i % every == 0)) for i in range(n)]
        weights, bias = toxicity.train(rows)
        score = lambda text: bias + sum(weights.get(h, 0) for h in set().union(*map(toxicity.heads, text.split())))  # noqa: E731,B023
        assert score("a stupid idiot moron") > 0 > score("hello nice day"), n


def test_abstaining_is_evidence_for_clean():
    import numpy as np

    votes = np.array([[1, 1, 0]] * 10 + [[0, 0, 0]] * 30, np.float32)
    post = toxicity.label_model(votes, np.array([1] * 10 + [0] * 30))
    assert (post[:10] > 0.9).all() and (post[10:] < 0.1).all()


def test_copies_of_a_voter_count_once():
    """Ten copies of a voter that is wrong on some rows don't outvote two voters that are right."""
    import numpy as np

    r = np.random.default_rng(3)
    labels = (r.random(2000) < 0.3).astype(int)
    noisy = (np.where(labels == 1, 0.6, 0.3) > r.random(2000)).astype(np.float32)
    good = [(np.where(labels == 1, 0.9, 0.05) > r.random(2000)).astype(np.float32) for _ in range(2)]
    votes = np.stack([noisy] * 10 + good, 1)
    assert len(set(toxicity.groups(votes, labels).tolist())) == 3
    one = toxicity.label_model(np.stack([noisy, *good], 1), labels)
    many = toxicity.label_model(votes, labels)
    assert np.abs(one - many).max() < 0.05 and ((many > 0.5) == labels).mean() > 0.93


def test_held_out_labels_change_no_score(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 8)))
    docs = [(i, " ".join([word() for _ in range(20)] + ["scum", "idiot"] * (i % 4 == 0))) for i in range(200)]
    table = spark.createDataFrame([*docs, (3, "x " * 100_000), (7, "another text of 7")], "doc_id long, text string")
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(held) > 20
    out = []
    for flip in (False, True):
        labels = [(i, int((i % 4 == 0) ^ (flip and i in held))) for i, _ in docs]
        model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out.append(sorted((x.doc_id, x.score) for x in toxicity.scores(table, model).collect()))
    assert out[0] == out[1] and len(out[0]) == 202
