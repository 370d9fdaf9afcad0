"""Suffix-array dedup: byte strings of ``WIDTH`` bytes that start anywhere else are removed.

The suffix array is sparse: of the suffixes it sorts those that winnowing picks,
the start of the least of the names of WIDTH - LEAD + 1 neighbouring LEAD-byte
strings, so any two equal strings of WIDTH bytes hold a picked suffix at the same
offset. A suffix is compared by its leading tokens: the name of its first LEAD
bytes, then that of all the windows it stands for. Sampled splitters
range-partition the suffixes by these tokens, buckets sort locally by multikey
quicksort, and neighbours are compared also across bucket boundaries (see
sorted_runs); where neighbours share only the first token, their windows are
compared one by one (see repeats).

Names are 64-bit hashes; what is removed agrees in two of them.

Defined cases: null and empty texts have 0 bytes; texts shorter than WIDTH lose
nothing; overlapping occurrences within one text count; of rows sharing a
doc_id the one with the smallest text counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

WIDTH, LEAD = 400, 300


def _values(salt: int) -> np.ndarray:
    return common.mixed(np.arange(256, dtype=np.uint64) + np.uint64(salt * 1000 + 1))


FIRST, SECOND = _values(1), _values(2)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, by doubling."""
    n, span, out = len(v) - width + 1, 1, v
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def anchors(text: str, width: int = WIDTH, lead: int = LEAD):
    b = _bytes(text)
    if len(b) < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    h = common.SpanHash(FIRST[b])
    at = np.arange(len(b) - lead + 1)
    names = h.spans(at, at + lead)
    bits = np.uint64(max(1, int(len(b)).bit_length()))
    low = sliding_min((names >> bits << bits) | at.astype(np.uint64), width - lead + 1)
    picked = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # by window: the suffix that stands for it
    begin = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    end = np.r_[begin[1:], len(picked)] - 1
    pos = picked[begin]
    around = common.mixed(h.spans(begin, end + width) + ((pos - begin) * 1_000_003 + (end - begin)).astype(np.uint64))
    return names[pos], around, pos, begin, end


def windows(text: str, starts: np.ndarray, width: int = WIDTH):
    b = _bytes(text)
    return common.SpanHash(FIRST[b]).spans(starts, starts + width), common.SpanHash(SECOND[b]).spans(starts, starts + width)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, lead: int = LEAD) -> DataFrame:
    """doc_id, starts, ends: byte spans to remove."""
    return repeats.repeated_spans(common.texts(docs), lambda t: anchors(t, width, lead), lambda t, s: windows(t, s, width), width, (width - lead) / 2)


def suffix_dedup(docs: DataFrame, width: int = WIDTH, lead: int = LEAD, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""

    def made(text, starts, ends):
        raw = text.encode()
        gone = repeats.covered(len(raw), starts, ends)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(starts) else raw
        out = {"n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        return out | ({"kept": kept} if keep_bytes else {})

    return repeats.applied(common.texts(docs), repeated_bytes(docs, width, lead), made, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)


def query(spark, sf_dir):
    return suffix_dedup(common.documents(spark, sf_dir), keep_bytes=False)
