import random
import re

from hypothesis import example, given, settings
from hypothesis import strategies as st

from knotwork.llm import pii


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-+ 0149(\n", max_size=50))
@example("a@b.c@d.e a@@b.c x@y z@y.z 4111 1111 1111 1111")
def test_base(text):
    assert pii.base_spans(text) == plain(text)


def test_field_on_unseen_sentences():
    field, right, found, marks = pii.train(), 0, 0, 0
    for text, gold in pii.generated(150, seed=99):
        got = set(field.spans(text))
        right, found, marks = right + len(got & set(gold)), found + len(got), marks + len(gold)
    assert right / found > 0.9 and right / marks > 0.9, (right, found, marks)


def test_table(spark):
    docs = spark.createDataFrame([(1, "call é (415) 555-2671, a@b.co"), (2, ""), (3, None), (None, "a@b.co"), (4, "x " * 200_000 + "a@b.co")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert sorted(out) == [1, 2, 3, 4] and out[2].spans == out[3].spans == []
    assert [tuple(s) for s in out[1].spans] == [("email", 23, 29), ("phone", 7, 21)] and [tuple(s) for s in out[4].base] == [("email", 400_000, 400_006)]
    assert pii.personal_data(docs.limit(0)).count() == 0
    clashing = spark.createDataFrame([(1, "a@b.co", 5), (1, "a@b.co", 5), (1, "c", 6)], "doc_id long, text string, spans int")
    assert sorted(len(r.spans) for r in pii.personal_data(clashing).collect()) == [0, 1, 1]


def test_search_equals_all_segmentations():
    """The dynamic programme finds the best of all ways to part a text into segments, under random weights."""
    r = random.Random(4)
    for _ in range(200):
        text = " ".join(r.choice(["1", "ab", "x@y", "33-4", "(at)", "z"]) for _ in range(r.randint(1, 4)))
        tokens = [t.span() for t in pii.TOKEN.finditer(text)][:7]
        field = pii.Field({})
        ends = field.segments(text, tokens)
        for e in ends:
            for _, fs in e:
                for k in pii.TYPES[1:]:
                    for f in fs:
                        field.weights.setdefault((k, f), r.uniform(-2, 3))
        score = {(i, j): max((field.score(k, fs), k) for k in pii.TYPES[1:]) for j, e in enumerate(ends) for i, fs in e}

        def best(j):
            """Of the first j tokens: score and spans."""
            if j == 0:
                return 0.0, []
            s, spans = best(j - 1)
            for i in range(j):
                if (i, j) in score:
                    t, before = best(i)
                    if t + score[i, j][0] > s:
                        s, spans = t + score[i, j][0], [*before, (score[i, j][1], tokens[i][0], tokens[j - 1][1])]
            return s, spans

        got = field.best(text, tokens)
        total = sum(score[next(i for i, t in enumerate(tokens) if t[0] == a), next(j for j, t in enumerate(tokens, 1) if t[1] == b)][0] for _, a, b in got)
        assert abs(total - best(len(tokens))[0]) < 1e-9
