import hashlib
import random

from knotwork.llm import decontamination, line_dedup


def test_line_dedup(spark):
    r = random.Random(4)
    lines = ["  The Same Line of text\t", "the same line of text", "short", "É" * 12, "é" * 12, "another long line 1", ""]
    docs = {0: None, 1: "", 2: "\n\n", 3: "a\r\n" * 200}
    docs |= {i: "\n".join(r.choices(lines, k=r.randint(0, 90))) for i in range(4, 60)}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i in sorted(docs):
        for k in map(key, (docs[i] or "").split("\n")):
            first.setdefault(k, i)
    table = spark.createDataFrame([(k, v, 1, "x") for k, v in docs.items()] + [(None, lines[0], 1, "x"), (3, docs[3], 2, "y")], "doc_id long, text string, pos int, bitmap string")
    got = {x.doc_id: x for x in line_dedup.line_dedup(table).collect()}
    assert sorted(got) == sorted(docs)
    for i, text in docs.items():
        every = (text or "").split("\n")
        kept = [line for line in every if len(key(line)) < 10 or first[key(line)] == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(every), len(every) - len(kept), "\n".join(kept)), i
    assert line_dedup.line_dedup(table.limit(0)).count() == 0


def test_decontamination(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(3, 8)))
    items = [[word() for _ in range(30)] for _ in range(20)]
    docs, want = {}, set()
    for i in range(200):
        text = [word() for _ in range(60)]
        if i % 4 == 0:
            item = list(items[i % 20])
            for k in range(r.randint(0, 4)):
                item[5 * k + 7] = word()
            text[20:20] = item
            want.add((i, i % 20))
        docs[i] = " ".join(text)
    table = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(900, None, "x"), (901, "", "x"), (None, "a", "x")], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(50, None), (51, "a b"), (None, "a b c")], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(table, bench).collect()} == want
    assert decontamination.contaminated(table.limit(0), bench).count() == 0 == decontamination.contaminated(table, bench.limit(0)).count()
