import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import media_mpeg as M


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_round_trip(payload):
    r = M.read(M.write(payload))
    assert r["payload"] == payload and r["bad_checksums"] == r["resyncs"] == 0
    assert r["frames"] == r["table"]["frames"] and r["duration_ms"] == 36 * r["frames"] and r["samples"] == {32000: 1152 * r["frames"]}


def test_damage():
    data = M.write(b"a" * 64 * 100)
    whole = M.read(data)
    at = whole["offsets"][2]
    broken = M.read(data[:at] + b"junk" + data[at:])
    assert broken["resyncs"] == 1 and broken["frames"] in (whole["frames"], whole["frames"] - 1)
    flipped = bytearray(data)
    flipped[at + 10] ^= 1
    assert M.read(bytes(flipped))["bad_checksums"] == 1
    for bad in (b"", b"ID3", b"\xff" * 50, b"TAG" + bytes(125), data[: at + 7], b"ID3\x04\0\xd0\0\0\0\x05" + b"\xff" * 9, b"ID3\x03\0\x40\0\0\0\x02ab"):
        M.read(bad)


#: version bits, layer, mono, bitrate index, rate index: size, samples a frame, rate, side information
FRAMES = [
    ((3, 3, False, 9, 0), (417, 1152, 44100, 32)),  # MPEG-1 layer III, 128 kbit/s
    ((3, 3, True, 5, 1), (192, 1152, 48000, 17)),  # 64 kbit/s
    ((2, 3, False, 8, 0), (208, 576, 22050, 17)),  # MPEG-2, 64 kbit/s
    ((0, 3, True, 4, 2), (288, 576, 8000, 9)),  # MPEG-2.5, 32 kbit/s
    ((3, 2, False, 8, 2), (576, 1152, 32000, 0)),  # layer II, 128 kbit/s
    ((2, 2, True, 8, 0), (417, 1152, 22050, 0)),  # layer II of MPEG-2, 64 kbit/s
    ((3, 1, False, 4, 2), (192, 384, 32000, 32)),  # layer I, 128 kbit/s
    ((2, 1, True, 1, 2), (96, 384, 16000, 16)),  # layer I of MPEG-2, 32 kbit/s
]


def frame(version, layer, mono, bitrate, rate, body=b"", checked=True, padding=0):
    head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | (not checked), bitrate << 4 | rate << 2 | padding << 1, 0xC0 if mono else 0])
    h = M.parse_header(head)
    side = bytes(h.side)
    out = head + (struct.pack(">H", M.crc16(head[2:] + side)) if checked else b"") + side + body
    return out + bytes(h.size - len(out))


@pytest.mark.parametrize("of, want", FRAMES)
def test_versions_and_layers(of, want):
    h = M.parse_header(frame(*of)[:4])
    assert (h.size, h.samples, h.rate, h.side) == want
    assert M.parse_header(frame(*of, padding=1)[:4]).size - h.size == (4 if of[1] == 1 else 1)
    r = M.read(b"".join(frame(*of, checked=k % 2 == 0) for k in range(7)))
    assert r["frames"] == 7 and r["samples"] == {want[2]: 7 * want[1]} and r["checked"] == 4 and r["bad_checksums"] == r["resyncs"] == 0
    assert r["verified"] == (0 if of[1] == 2 else 4) and abs(r["duration_ms"] - 7000 * want[1] / want[2]) < 1e-9
    assert r["offsets"] == [k * want[0] for k in range(7)]


def test_headers_that_are_none():
    for head in (b"\xff\xea\x90\x00", b"\xff\xf8\x90\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xfb\x90\x02", b"\xff\xfb"):
        assert M.parse_header(head) is None


def test_durations_of_mixed_rates_are_exact():
    r = M.read(frame(3, 3, False, 9, 0) * 3 + frame(3, 3, False, 9, 1) * 2)
    assert r["samples"] == {44100: 3456, 48000: 2304} and r["duration_ms"] == float(3456000 / 44100 + 48)


@pytest.mark.parametrize("of", [(3, 3, False, 9, 0), (3, 3, True, 9, 0), (2, 3, False, 12, 0), (0, 3, True, 14, 0)])
@pytest.mark.parametrize("checked", [True, False])
def test_tables(of, checked):
    sound = frame(*of) * 4
    xing = M.read(frame(*of, body=b"Info" + struct.pack(">III", 7, 4, len(sound)) + bytes(range(100)), checked=checked) + sound)
    assert xing["frames"] == 4 and xing["table"] == {"kind": "Info", "frames": 4, "bytes": len(sound), "seek": [k / 256 for k in range(100)]}
    few = M.read(frame(*of, body=b"Xing" + struct.pack(">II", 2, 99), checked=checked) + sound)
    assert few["table"] == {"kind": "Xing", "frames": None, "bytes": 99, "seek": []}
    first = bytearray(frame(*of, checked=checked))
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, len(sound), 4, 3, 2, 2, 1) + struct.pack(">HHH", 10, 20, 30)
    first[36 : 36 + len(vbri)] = vbri
    if checked:  # the table may lie over the side information; its checksum counts as any other
        first[4:6] = struct.pack(">H", M.crc16(bytes(first[2:4]) + bytes(first[6 : 6 + M.parse_header(bytes(first[:4])).side])))
    assert M.read(bytes(first) + sound)["table"] == {"kind": "VBRI", "frames": 4, "bytes": len(sound), "seek": [0, 20, 60]}


def test_tags():
    spread = M._spread
    v3 = lambda k, v: k + struct.pack(">IH", len(v), 0) + v
    v4 = lambda k, v, f=0: k + spread(len(v)) + struct.pack(">H", f) + v
    tag = lambda major, flags, body: b"ID3" + bytes([major, 0, flags]) + spread(len(body)) + body
    sound = frame(3, 3, False, 9, 0) * 2
    cases = {
        tag(2, 0, b"TT2\0\0\x04\0abc" + b"TXX\0\0\x06\0k\0val"[:12]): [("TT2", "", "abc"), ("TXX", "k", "val")],
        tag(3, 0, v3(b"TIT2", b"\x01" + "hé".encode("utf-16")) + v3(b"APIC", b"\xff\xfb\x90\0") + bytes(20)): [("TIT2", "", "hé"), ("APIC", "", "")],
        tag(3, 0x40, struct.pack(">IHI", 6, 0, 0) + v3(b"TIT2", b"\0x")): [("TIT2", "", "x")],
        tag(3, 0x80, v3(b"TIT2", b"\0\xff\xe0").replace(b"\xff", b"\xff\0")): [("TIT2", "", "\xff\xe0")],
        tag(4, 0x40, spread(6) + b"\x01\0" + v4(b"TIT2", b"\x03h\xc3\xa9" + b"x" * 200)): [("TIT2", "", "hé" + "x" * 200)],
        tag(4, 0, v4(b"TIT2", b"\0\0\0\x03\0\xff\0a", 3)): [("TIT2", "", "\xffa")],
        tag(4, 0x10, v4(b"TXXX", b"\x03key\0value")) + b"3DI\x04\0\x10\0\0\0\x16": [("TXXX", "key", "value")],
    }
    for raw, want in cases.items():
        r = M.read(raw + sound + b"TAG" + b"name".ljust(125, b"\0"))
        assert r["tags"] == [*want, ("ID3v1", "", "name")] and r["frames"] == 2 and r["resyncs"] == 0, raw


def test_table(spark):
    docs = spark.createDataFrame([(1, "héllo", 1), (2, "", 2), (3, None, 3), (None, "x", 4), (4, "z" * 300_000, 5), (5, "héllo", 6), (5, "héllo", 6), (5, "other", 6)], "doc_id long, text string, media int")
    rows = M.media(docs).collect()
    out = {r.doc_id: r for r in rows if r.n_bytes != 5}
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 5, 5]
    assert out[1].payload_bytes == 64 and out[1].n_bytes == 6 and out[4].payload_bytes == 300_032
    assert out[1].tail_crc32 == zlib.crc32("héllo".encode() + bytes(58)) and out[2].payload_bytes == out[3].payload_bytes == 64
    assert out[1].media_sha256 == out[5].media_sha256 and out[1].feature == out[5].feature
    assert M.read(bytes(out[4].media))["payload"][:300_000] == b"z" * 300_000 and sum(out[4].samples.values()) == 1152 * len(out[4].offsets)
    assert M.media(docs.limit(0)).count() == 0
