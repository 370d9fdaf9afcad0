import random
import re

import pytest

from knotwork.llm import decontamination


def split(text):
    ascii_lower = lambda w: "".join(c.lower() if c < "\x80" else c for c in w)
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or "")) if w]


def brute(docs, items):
    """n_match, n_item of each pair with a seed in common, by laying every item beside every place of every document."""
    out = {}
    for d, text in docs.items():
        h = split(text)
        for i, b in items:
            b = split(b)
            n = len(b)
            masks = decontamination.masks_of(n)
            hit = {}
            for diagonal in range(-n + 1, len(h)):
                same = {j for j in range(n) if 0 <= diagonal + j < len(h) and h[diagonal + j] == b[j]}
                if n and any(all(j + o in same for o in m) for m in masks for j in range(n - m[-1])):
                    hit[diagonal] = same
            best = 0
            for shift in (0, n):
                stretches = {}
                for diagonal, same in hit.items():
                    stretches.setdefault((diagonal + shift) // (2 * n), set()).update(same)
                best = max([best, *map(len, stretches.values())])
            if hit and (out.get((d, i)) is None or best * out[d, i][1] > out[d, i][0] * n):
                out[d, i] = (best, n)
    return out


def tables(spark, docs, items):
    return spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(None, "a b", "y")], "doc_id long, text string, item string"), spark.createDataFrame(items + [(None, "a b c d")], "item_id long, text string")


def test_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdé", k=2))  # noqa: E731  25 words, so that chance hits abound
    items = [(i, " ".join(word() for _ in range(r.choice((1, 3, 7, 8, 9, 12, 20, 70))))) for i in range(24)] + [(50, None), (51, ""), (52, "?!"), (0, "zz yy xx")]
    docs = {0: None, 1: "", 2: "ab", 3: "-- \n"}
    for d in range(4, 60):
        text = [word() for _ in range(r.randint(0, 80))]
        b = split(r.choice(items)[1])
        for _ in range(len(b) // 3):
            b[r.randrange(len(b))] = word()
        at = r.randint(0, len(text))
        docs[d] = " ".join(text[:at] + b[: len(b) // 2] + [word()] * r.randint(0, 9) + b[len(b) // 2 :] + text[at:]).upper()
    got = {(x.doc_id, x.item_id): (x.n_match, x.n_item) for x in decontamination.overlaps(*tables(spark, docs, items)).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_repeated_phrase_counts_once(spark):
    item = [f"i{k}" for k in range(60)]
    phrase = item[40:49]
    filler = iter(f"f{k}" for k in range(10_000))
    pad = lambda n: [next(filler) for _ in range(n)]
    docs = {
        1: pad(20) + sum((phrase + pad(11) for _ in range(4)), []),  # 9 of 60 words, four times over
        2: pad(5) + item[:15] + pad(7) + item[40:55] + pad(3),  # 30 words in two parts, on two diagonals
        3: item[:15] + pad(7) + item[40:54] + pad(3),  # 29
        4: item,
        5: sum((phrase + pad(1) for _ in range(300)), []),
        6: item[:15] + pad(500) + item[40:55],  # two parts far from each other are no quotation
        7: pad(9) + "the whole short item".split() + pad(2),
        8: pad(9) + "the whole short thing".split(),
    }
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[40:49] + [f"x{k}" for k in range(191)])), (9, "The whole: short item")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_match, x.n_item) for x in decontamination.overlaps(table, bench).collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == 7} == {1: (9, 60), 2: (30, 60), 3: (29, 60), 4: (60, 60), 5: (9, 60), 6: (15, 60)}
    assert all(v == (9, 200) for k, v in got.items() if k[1] == 8)
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(table, bench).collect()} == {(2, 7), (4, 7), (7, 9)}


@pytest.mark.parametrize("n", range(9, 41))
def test_recall_at_the_promised_share(n):
    """Of items with half of their words replaced, at random places, at least 0.9 keep a seed, whatever their length."""
    r = random.Random(n)
    kept = 0
    for _ in range(2000):
        same = set(r.sample(range(n), -(-n // 2)))
        kept += any(all(j + o in same for o in m) for m in decontamination.masks_of(n) for j in range(n - m[-1]))
    assert kept / 2000 >= 0.9, kept


def test_long_texts_and_repeated_ids(spark):
    item = " ".join(f"i{k}" for k in range(16))
    docs = [(1, f"{'pad ' * 200_000}{item} {'pad ' * 200_000}"), (2, item), (2, "a smaller text"), (3, "x"), (3, None), (4, item), (4, item)]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted((x.doc_id, x.n_match, x.n_item) for x in got.collect()) == [(1, 16, 16), (4, 16, 16)]
