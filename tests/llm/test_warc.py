import base64
import hashlib
import random

import pytest

from knotwork.llm import common, warc

SCHEMA = "page_id long, url string, html string, piece string, block int"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77777>\r\nContent-Length: 40\r\n\r\n" + "HTTP/1.1 200 OK\r\n\r\n" + "f" * 21 + "\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def made(r: random.Random) -> list[tuple]:
    parts = ["WARC/1.", "WARC/1.1\r\n", "\r\n\r\n", "Content-Length: 3\r\n", FAKE, "<p>é漢</p>", "WARC/1.0\r\nContent-Length: 9\r\n\r\n", "\n", "x" * 50]
    rows = [(i, f"http://h/{i} \n", r.choice(["".join(r.choices(parts, k=r.randint(0, 12))), "same page", "same " + FAKE, None, ""]), "x", 1) for i in range(300)]
    return rows + [(400, None, "WARC/1." * 20_000, "x", 1), (401, "u", "long " * 100_000, "x", 1), (402, "u", FAKE * 300, "x", 1), (None, "u", "lost", "x", 1), (3, "u", "repeated", "x", 1), (5, "u", None, "x", 1)]


@pytest.mark.parametrize("split", [700, 5_000, 128 << 20])
def test_archives_come_back(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(warc, "FILE_RECORDS", 60)
    rows = made(random.Random(split))
    payloads: dict[int, bytes] = {}
    for page, _, html, *_ in rows:
        if page is not None:
            payloads[page] = min(payloads.get(page, b"\xff"), (html or "").encode())
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/files")
        got = {x.record_id: x for x in warc.read(spark, f"{tmp_path}/files", f"{tmp_path}/scratch").collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
    largest = {p: max(i for i in payloads if payloads[i] == p) for p in payloads.values()}
    assert sorted(got) == sorted(f"<urn:page:{i}>" for i in payloads)
    for i, payload in payloads.items():
        x, kept = got[f"<urn:page:{i}>"], largest[payload]
        assert x.whole and x.payload_digest == digest(payload) and f"Content-Length: {len(payload)}" in x.http
        if kept == i:
            assert (x.record_type, bytes(x.payload), x.refers_to) == ("response", payload, None), i
        else:
            assert (x.record_type, bytes(x.payload), x.refers_to) == ("revisit", b"", f"<urn:page:{kept}>"), i


def test_broken_and_foreign_files(spark, tmp_path):
    record = lambda k, body: f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID:<{k}>\r\ncontent-length:{len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes((record(1, "HTTP/1.1 200 OK\r\n\r\nabc") + record(2, "") + record(3, "cut short")[:-8]).encode())
    (tmp_path / "in/b.warc").write_bytes(b"no archive at all WARC/1.")
    (tmp_path / "in/c.warc").write_bytes(b"")
    got = {x.record_id: (bytes(x.payload), x.whole) for x in warc.read(spark, f"{tmp_path}/in", f"{tmp_path}/s").collect()}
    assert got["<1>"] == (b"abc", True) and got["<2>"][1] and not got["<3>"][1] and len(got) == 3


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/files")
    assert warc.read(spark, f"{tmp_path}/files", f"{tmp_path}/s").count() == 0


def test_small_payloads_stay_responses(spark, tmp_path):
    warc.write(spark.createDataFrame([(i, "u", t, "x", 1) for i, t in enumerate(["ab", "ab", "abcd", "abcd"])], SCHEMA), f"{tmp_path}/files", least=3)
    got = warc.read(spark, f"{tmp_path}/files", f"{tmp_path}/s").select("record_id", "record_type").collect()
    assert sorted(map(tuple, got)) == [("<urn:page:0>", "response"), ("<urn:page:1>", "response"), ("<urn:page:2>", "revisit"), ("<urn:page:3>", "response")]
    assert common.SMALL_ROWS
