"""Long repeats: from anchors that any two equal windows share to the windows themselves.

A method supplies anchors: places chosen so that two equal windows hold one at
the same offset. An anchor stands for a range of windows around it and carries
two names: ``core``, of the part all these windows share, and ``around``, of all
they cover. Anchors that agree in both names (twins) have nothing but repeated
windows. Anchors that agree in the core alone, at the edges of a repeat, have
their windows compared one by one, against each other and against one twin of
each kind. So the work grows with the repeats' edges, not with their copies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sorted_runs import SAMPLE_A_BUCKET, SAMPLE_ROWS, bucket_of, buckets_for, cuts, repeated

Anchors = Callable[[str], tuple[np.ndarray, ...]]  # core, around, pos, begin, end: windows start in begin..end
Windows = Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]]  # two names of the windows at some starts


#: Rows that Python gives back at a time, and how many times more rows are sampled than are wanted, so that they come from more documents.
ROWS, OVERSAMPLED = 200_000, 8


def _rows(d: DataFrame, names: list[str], make, order: list[str] = (), splitters: list[np.ndarray] | None = None) -> DataFrame:
    """doc_id and the columns that make(row) gives for each row, all longs; with splitters of the columns ``order`` also bucket, an int."""
    import pyarrow as pa

    columns = ["doc_id", *names]
    common.bounded_batches(d.sparkSession)

    def batch_of(held):
        made = [np.concatenate(c).astype(np.int64, copy=False) for c in zip(*held)]
        out = [pa.array(c) for c in made]
        if splitters is not None:
            out.append(pa.array(bucket_of([made[columns.index(c)] for c in order], splitters).astype(np.int32)))
        return pa.RecordBatch.from_arrays(out, names=columns + ["bucket"] * (splitters is not None))

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                got = make(row)
                if len(got[0]):
                    held.append([np.full(len(got[0]), row["doc_id"], np.int64), *got])
                    size += len(got[0])
                if size > ROWS:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return d.mapInArrow(run, ", ".join(f"{n} long" for n in columns) + ", bucket int" * (splitters is not None))


def _repeated(read: Callable[[F.Column], DataFrame], names: list[str], make, keys: list[str], ties: list[str], estimate: int) -> DataFrame:
    """repeated() over make()'s rows of the documents that read(a condition on doc_id) gives.

    Splitters come from the rows of a few documents (by hash), so all others are made once.
    """
    order = [*keys, *ties]
    spark = read(F.lit(False)).sparkSession
    buckets = buckets_for(spark, estimate)
    wanted = min(SAMPLE_A_BUCKET * buckets, SAMPLE_ROWS)
    share = min(1.0, OVERSAMPLED * wanted / max(1, estimate))
    some = _rows(read(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1), names, make)
    some = some.where(F.pmod(F.xxhash64(*order), F.lit(OVERSAMPLED)) == 0)
    return repeated(_rows(read(F.lit(True)), names, make, order, cuts(some, order, buckets)), keys, ties, buckets)


def repeated_spans(d: DataFrame, anchors: Anchors, windows: Windows, width: int, bytes_an_anchor: float) -> DataFrame:
    """doc_id, starts, ends: the spans of the repeated windows of each document that has any (they may overlap).

    A document's own spans and edges gather in a row; they grow with that one text.
    """
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchored(row):
        core, around, pos, begin, end = anchors(row["text"] or "")
        return core.view(np.int64), around.view(np.int64), pos, begin, end

    found = _repeated(d.where, ["core", "around", "pos", "begin", "end"], anchored, ["core", "around"], ["doc_id", "pos"], int(total / bytes_an_anchor))
    whole = found.where("twin").select("doc_id", "begin", (F.col("end") + width).alias("end"))
    edge = found.where("not twin or (head and mixed)").groupBy("doc_id").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"), F.sum(F.col("end") - F.col("begin") + 1).alias("n"))
    edge = common.cut(edge)
    count = edge.agg(F.sum("n")).first()[0]

    def one_by_one(some):
        return d.where(some).join(edge.where(some), "doc_id").select("doc_id", "text", "begins", "ends")

    def compared(row):
        parts = [np.arange(a, b + 1) for a, b in zip(row["begins"], row["ends"])]
        starts = np.unique(np.concatenate(parts))
        one, two = windows(row["text"], starts)
        return one.view(np.int64), two.view(np.int64), starts

    singles = _repeated(one_by_one, ["one", "two", "start"], compared, ["one", "two"], ["doc_id", "start"], int(count or 0))
    spans = whole.unionByName(singles.where("twin").select("doc_id", F.col("start").alias("begin"), (F.col("start") + width).alias("end")))
    return spans.groupBy("doc_id").agg(F.collect_list("begin").alias("starts"), F.collect_list("end").alias("ends"))


def covered(n: int, starts, ends) -> np.ndarray:
    """Which of n units the spans cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.asarray(starts, np.int64), 1)
    np.add.at(change, np.asarray(ends, np.int64), -1)
    return np.cumsum(change[:-1]) > 0


def applied(d: DataFrame, spans: DataFrame, make, schema: str) -> DataFrame:
    """doc_id and make(text, starts, ends) for every document; spans are none where it has no repeat."""
    import pandas as pd

    joined = d.join(spans, "doc_id", "left")
    common.bounded_batches(d.sparkSession)

    def run(frames):
        for f in frames:
            rows = [make(t or "", () if a is None else a, () if b is None else b) for t, a, b in zip(f["text"], f["starts"], f["ends"])]
            yield pd.concat([f[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return joined.select("doc_id", "text", "starts", "ends").mapInPandas(run, f"doc_id long, {schema}")
