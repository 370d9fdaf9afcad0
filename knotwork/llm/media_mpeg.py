"""Media columns as MPEG audio.

Payload bytes are kept as the ancillary data of silent MPEG-1 layer III frames
(stereo, 32 kHz, checksummed), behind an ID3v2 tag and a variable-bitrate table
and before an ID3v1 tag. The reader takes MPEG-1, 2 and 2.5 in layers I to III,
stereo and mono: it parses ID3v2.2 to 2.4 tags and Xing, Info and VBRI tables,
resynchronises on frame headers wherever bytes are damaged or foreign, verifies
checksums, counts samples by rate and gives the byte offset of every frame.

Defined cases: null and empty texts have a payload of 64 zero bytes; equal
texts have equal values; bytes without any frame parse to no frames, no payload
and a duration of 0; repeated rows give equal rows.

Limits: checksums of layer II frames are counted but not verified, for they
cover allocation tables that the reader doesn't decode; frames of free bitrate
are passed over like foreign bytes; the payload is what follows the side
information, as this writer lays it out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import common

#: Fixed values of the format: kbit/s by index for (MPEG-1, layer), and for MPEG-2 and 2.5; samples a second of MPEG-1.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Bytes of side information in layer III by (MPEG-1?, mono?); versions by the header's two bits, with what divides the rates.
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
VERSIONS = {3: ("1", 1), 2: ("2", 2), 0: ("2.5", 4)}


class Header(NamedTuple):
    version: str
    layer: int
    size: int
    rate: int
    samples: int
    side: int  # bytes of side information; in layer I of bit allocation
    checked: bool  # a checksum follows the header


@lru_cache(4096)
def parse_header(head: bytes) -> Header | None:
    """The frame header in four bytes, or None."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 4 or not 0 < index < 15 or rate == 3 or head[3] & 3 == 2:
        return None
    first, mode = version[0] == "1", head[3] >> 6
    bits, hertz, padding = BITRATES[1 if first else 2, layer][index] * 1000, RATES[rate] // version[1], head[2] >> 1 & 1
    if layer == 1:
        bound = 4 * (head[3] >> 4 & 3) + 4 if mode == 1 else 32
        size, samples, side = (12 * bits // hertz + padding) * 4, 384, 16 if mode == 3 else (bound + 32) // 2
    else:
        samples = 1152 if first or layer == 2 else 576
        size, side = samples // 8 * bits // hertz + padding, SIDE[first, mode == 3] if layer == 3 else 0
    return Header(version[0], layer, size, hertz, samples, side, not head[1] & 1)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


@lru_cache(64)
def _frame_start(bitrate: int) -> bytes:
    head = bytes([0xFF, 0xFA, bitrate << 4 | 2 << 2, 0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(32))) + bytes(32)


#: Bytes of a written frame's head, checksum and side information; of its whole by bitrate index; and what these leave for the payload.
BODY = 4 + 2 + 32
FRAME = {b: 144 * BITRATES[1, 3][b] * 1000 // 32000 for b in range(1, 15)}
ROOM = {b: n - BODY for b, n in FRAME.items()}


def write(payload: bytes) -> bytes:
    """The payload as an MPEG audio file; its frames have as few bytes as hold it."""
    full, rest = divmod(len(payload), ROOM[14])
    start = _frame_start(14)
    frames = [start + payload[i * ROOM[14] : (i + 1) * ROOM[14]] for i in range(full)]
    if rest:
        b = next(b for b in ROOM if ROOM[b] >= rest)
        frames.append(_frame_start(b) + payload[full * ROOM[14] :] + bytes(ROOM[b] - rest))
    total = sum(map(len, frames))
    seek = [min(i * FRAME[14], total) * 256 // max(1, total) for i in (len(frames) * p // 100 for p in range(100))]
    info = _frame_start(5) + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(min(255, x) for x in seek)
    info += bytes(FRAME[5] - len(info))
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"".join([b"ID3\x03\0\0", _spread(len(tag)), tag, info, *frames, b"TAG" + bytes(125)])


def _spread(n: int) -> bytes:
    """A number in four bytes of seven bits."""
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _gathered(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(raw: bytes) -> list[str]:
    """The strings of a text frame, by its encoding byte."""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0]) if raw else None
    return raw[1:].decode(name, "replace").rstrip("\0").split("\0") if name else []


def read_tag(data: bytes) -> tuple[list[tuple[str, str, str]], int]:
    """(frame, description, value) of the ID3v2 tag at the start, and where it ends; binary frames have empty values."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return [], 0
    major, flags, size = data[3], data[5], _gathered(data[6:10])
    end = min(len(data), 10 + size + (10 if major == 4 and flags & 0x10 else 0))
    body = data[10 : 10 + size]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, tags = 0, []
    if flags & 0x40 and major > 2 and len(body) >= 4:
        at = _gathered(body) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide = 3 if major == 2 else 4
    while at + wide * 2 <= len(body) and body[at : at + wide].isalnum():
        kind, raw = body[at : at + wide].decode("latin-1"), body[at + wide : at + 2 * wide]
        n = _gathered(raw) if major == 4 else int.from_bytes(raw, "big")
        at += 2 * wide + (2 if major > 2 else 0)
        value = body[at : at + n]
        if major == 4 and body[at - 1] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if major == 4 and body[at - 1] & 1:
            value = value[4:]  # the length before unsynchronising
        at += n
        words = _text(value) if kind[0] == "T" else []
        own = kind in ("TXXX", "TXX") and len(words) > 1
        tags.append((kind, words[0] if own else "", "; ".join(words[1:] if own else words)))
    return tags, end


def read_table(data: bytes, p: int, h: Header) -> dict | None:
    """kind, frames, bytes and seek (fractions of the bytes, or byte offsets by VBRI) of a variable-bitrate table in the frame at p."""
    for at in (p + 4 + h.side, p + 6 + h.side):
        if data[at : at + 4] in (b"Xing", b"Info") and at + 8 <= len(data):
            flags, q = struct.unpack(">I", data[at + 4 : at + 8])[0], at + 8
            out = {"kind": data[at : at + 4].decode(), "frames": None, "bytes": None, "seek": []}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["seek"] = [b / 256 for b in data[q : q + 100]]
            return out
    at = p + 36
    if data[at : at + 4] == b"VBRI" and at + 26 <= len(data):
        total, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", data[at + 10 : at + 26])
        raw, seek = data[at + 26 : at + 26 + entries * width], [0]
        for k in range(entries):
            seek.append(seek[-1] + int.from_bytes(raw[k * width : (k + 1) * width], "big") * scale)
        return {"kind": "VBRI", "frames": frames, "bytes": total, "seek": seek[:-1]}
    return None


def read(data: bytes) -> dict:
    """payload, frames, duration_ms, samples (by rate), offsets, checked, verified, bad_checksums, resyncs, table, tags."""
    tags, p = read_tag(data)
    end, length = len(data), next((int(v) for _, name, v in tags if name == "payload_bytes" and v.isascii() and v.isdigit()), None)
    if data[-128:-125] == b"TAG":
        end -= 128
        tags.append(("ID3v1", "", data[-125:-95].rstrip(b"\0 ").decode("latin-1")))
    at = lambda q: parse_header(data[q : q + 4])
    offsets, parts, samples, table = [], [], {}, None
    checked = verified = bad = resyncs = 0
    while p < end:
        h = at(p)
        # a frame counts if the next one, or the end, follows it
        if h is None or p + h.size > end or not (p + h.size == end or at(p + h.size)):
            resyncs += 1
            p = data.find(b"\xff", p + 1, end)
            while p >= 0 and at(p) is None:
                p = data.find(b"\xff", p + 1, end)
            if p < 0:
                break
            continue
        body = p + 4 + 2 * h.checked + h.side
        if h.checked:
            checked += 1
            if h.layer != 2:
                verified += 1
                bad += crc16(data[p + 2 : p + 4] + data[p + 6 : body]) != data[p + 4] << 8 | data[p + 5]
        if not offsets and table is None and h.layer == 3 and (table := read_table(data[: p + h.size], p, h)):
            pass  # a table's frame has no sound
        else:
            offsets.append(p)
            parts.append(data[body : p + h.size])
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        p += h.size
    payload = b"".join(parts)
    exact = sum((Fraction(n * 1000, rate) for rate, n in samples.items()), Fraction())
    return {
        "payload": payload if length is None else payload[:length], "frames": len(offsets), "duration_ms": float(exact), "samples": samples, "offsets": offsets,
        "checked": checked, "verified": verified, "bad_checksums": bad, "resyncs": resyncs, "table": table, "tags": tags,
    }


KINDS = {
    "media": "binary", "offsets": "array<int>", "samples": "map<int,bigint>", "duration_ms": "double", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string",
    "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string",
}


def media(docs: DataFrame, outputs: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """doc_id and the outputs asked for: the stored file, its seek offsets and duration, and the figures of the payload read back."""

    def one(text):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = write(payload)
        r = read(stored)
        back = r["payload"]
        feature = f"mpeg1-layer3;frames={r['frames']};ms={r['duration_ms']:g};table={r['table']['frames']};bad={r['bad_checksums']}/{r['checked']};resyncs={r['resyncs']};offsets={zlib.crc32(struct.pack(f'<{len(r['offsets'])}I', *r['offsets'])):08x}"
        return {
            "media": stored, "offsets": r["offsets"], "samples": list(r["samples"].items()), "duration_ms": r["duration_ms"], "n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
            "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature,
        }

    def start():
        def made(texts):
            rows = [one(t) for t in texts]
            return {k: [r[k] for r in rows] for k in outputs}

        return made

    return common.per_text(docs, ", ".join(f"{k} {KINDS[k]}" for k in outputs), start)


def query(spark, sf_dir):
    return media(common.documents(spark, sf_dir), ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
