"""Substring dedup: runs of ``WIDTH`` words that start anywhere else are removed.

Anchors stand only at cover positions: word positions whose remainder modulo
PERIOD is in COVER, a difference cover. For any two positions there is a shift
below PERIOD that takes both to cover positions, so two equal windows share an
aligned anchor, whose core of WIDTH - PERIOD + 1 words lies in both. Anchors with
equal cores are then extended (see repeats).

Defined cases: null and empty texts have no words; texts of fewer than WIDTH
words lose nothing; overlapping occurrences within one text count; of rows
sharing a doc_id the one with the smallest text counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import common, repeats

#: Each remainder from 1 to 20 is a difference of exactly one pair of the cover.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WIDTH = 35


def anchors(text: str, width: int = WIDTH):
    h = common.word_hashes(text.encode())
    core = width - PERIOD + 1
    if len(h) < width:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    at = np.arange(len(h) - core + 1)
    at = at[np.isin(at % PERIOD, COVER)]
    begin, end = np.maximum(0, at - PERIOD + 1), np.minimum(at, len(h) - width)
    s = common.SpanHash(h)
    around = common.mixed(s.spans(begin, end + width) + ((at - begin) * 1_000_003 + (end - begin)).astype(np.uint64))
    return s.spans(at, at + core), around, at, begin, end


def windows(text: str, starts: np.ndarray, width: int = WIDTH):
    h = common.word_hashes(text.encode())
    return common.SpanHash(h).spans(starts, starts + width), common.SpanHash(common.mixed(h)).spans(starts, starts + width)


def repeated_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, starts, ends: word spans to remove. width is at least PERIOD."""
    return repeats.repeated_spans(common.texts(docs), lambda t: anchors(t, width), lambda t, s: windows(t, s, width), width, 27)


def substring_dedup(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space."""

    def made(text, starts, ends):
        words = common.WORD.findall(text)
        gone = repeats.covered(len(words), starts, ends)
        kept = " ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(starts) else words)
        return {"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()} | ({"kept": kept} if keep_text else {})

    return repeats.applied(common.texts(docs), repeated_words(docs, width), made, "n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def query(spark, sf_dir):
    return substring_dedup(common.documents(spark, sf_dir), keep_text=False)


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents where doc_id is not null
), s as (
  select doc_id, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35
), h as (
  select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as k from s
), rep as (
  select k from h group by k having count(*) > 1
), gone as (
  select distinct h.doc_id, unnest(range(h.i, h.i + 35)) as j from h join rep using (k)
), words as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w where len(ws) > 0
), kept as (
  select o.doc_id, count(*)::bigint as n_words, count(g.j)::bigint as n_removed, string_agg(case when g.j is null then o.word end, ' ' order by o.j) as kept
  from words o left join gone g on o.doc_id = g.doc_id and o.j = g.j group by o.doc_id
)
select w.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""
