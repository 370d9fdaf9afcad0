"""Equal neighbours in a globally sorted table, without gathering a group anywhere.

Rows are range-partitioned by sampled splitters on all sort columns, so even one
key that holds a third of all rows is dealt over many buckets. A bucket sorts
locally by multikey quicksort. Runs that touch a bucket's edge are compared
across boundaries in Spark: a key that stands at the edges of two buckets goes on
from one to the other. Nothing but the splitters' sample reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows meant for a bucket, rows from which a part is split by a pivot rather than sorted at once.
BUCKET_ROWS, PIVOT_ROWS = 400_000, 1 << 16
#: Sampled rows a bucket and in all, and buckets up to which the few rows at their edges (two a bucket) are broadcast.
SAMPLE_A_BUCKET, SAMPLE_ROWS, BROADCAST_BUCKETS = 100, 1_000_000, 100_000
REPEATED, TWIN, HEAD, MIXED, FIRST_RUN, LAST_RUN, FIRST_CLASS, LAST_CLASS, FIRST, LAST = (1 << k for k in range(10))


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by the columns, most significant first: three-way partition on one column, equal parts go on with the next."""
    out, todo = [], [(np.arange(len(columns[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == len(columns) or len(rows) < 2:
            out.append(rows)
            continue
        x = columns[depth][rows]
        if len(rows) > PIVOT_ROWS:
            pivot = np.sort(x[:: max(1, len(x) // 101)])[50 if len(x) >= 101 else len(x) // 2]
            todo += [(rows[x > pivot], depth), (rows[x == pivot], depth + 1), (rows[x < pivot], depth)]
            continue
        order = np.argsort(x, kind="stable")
        rows, x = rows[order], x[order]
        tied = np.zeros(len(rows), bool)
        same = x[1:] == x[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if depth + 1 < len(columns) and tied.any():
            part = rows[tied]
            rows[tied] = part[np.lexsort([columns[k][part] for k in range(len(columns) - 1, depth, -1)] + [x[tied]])]
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _marks(core: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """Marks of sorted rows; core, twin: whether a row's first key, or all its keys, equal those of the row before."""
    n = len(core)
    run, group = np.cumsum(~core) - 1, np.cumsum(~twin) - 1
    mark = np.where(np.bincount(run)[run] > 1, REPEATED, 0) | np.where(np.bincount(group)[group] > 1, TWIN, 0) | np.where(twin, 0, HEAD)
    classes = np.bincount(run, weights=~twin)
    mark |= np.where(classes[run] > 1, MIXED, 0)
    mark |= np.where(run == 0, FIRST_RUN, 0) | np.where(run == run[-1], LAST_RUN, 0)
    mark |= np.where(group == 0, FIRST_CLASS, 0) | np.where(group == group[-1], LAST_CLASS, 0)
    mark[0] |= FIRST
    mark[n - 1] |= LAST
    return mark


def buckets_for(spark: SparkSession, estimate: int) -> int:
    return max(common.partitions(spark), -(-estimate // BUCKET_ROWS))


def cuts(sample: DataFrame, order: list[str], buckets: int) -> list[np.ndarray]:
    """buckets - 1 splitters, a column each, from at most SAMPLE_ROWS sampled rows."""
    rows = sample.select(order).limit(SAMPLE_ROWS).toPandas()
    columns = [rows[c].to_numpy(np.int64) for c in order]
    at = multikey_quicksort(columns)
    return [c[at[np.arange(1, buckets) * len(at) // buckets]] if len(at) else c for c in columns]  # none: all rows go to one bucket


def bucket_of(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or below each row; later columns count where earlier ones tie."""
    out = np.searchsorted(cuts[0], columns[0], "right")
    if len(columns) == 1:
        return out
    low = np.searchsorted(cuts[0], columns[0], "left")
    tied = np.flatnonzero(low < out)
    for k in np.unique(low[tied]):
        at = tied[low[tied] == k]
        out[at] = k + bucket_of([c[at] for c in columns[1:]], [c[k : out[at[0]]] for c in cuts[1:]])
    return out


def repeated(rows: DataFrame, keys: list[str], ties: list[str], buckets: int) -> DataFrame:
    """The rows whose first key occurs more than once, with booleans twin (all keys do), head (first row of its keys) and mixed (its first key has other second keys).

    All columns are longs without nulls, but for an int column bucket: where rows have it, it
    tells their bucket by bucket_of; else Spark samples splitters, which makes the rows twice.
    The result is cut, for it is small beside the input and read more than once.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = [c for c in rows.columns if c != "bucket"]
    order = [*keys, *ties]
    schema = ", ".join(f"{n} long" for n in names) + ", bucket int, mark int"
    common.bounded_batches(rows.sparkSession)

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        columns = {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}
        parts.clear()
        at = multikey_quicksort([columns[k] for k in order])
        columns = {n: c[at] for n, c in columns.items()}
        core, twin = np.zeros(len(at), bool), np.zeros(len(at), bool)
        core[1:] = columns[keys[0]][1:] == columns[keys[0]][:-1]
        twin[1:] = core[1:]
        for k in keys[1:]:
            twin[1:] &= columns[k][1:] == columns[k][:-1]
        mark = _marks(core, twin)
        keep = (mark & (REPEATED | FIRST_RUN | LAST_RUN)) > 0
        arrays = [pa.array(columns[n][keep]) for n in names]
        count = int(keep.sum())
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(count, TaskContext.get().partitionId(), np.int32)), pa.array(mark[keep].astype(np.int32))], names=[*names, "bucket", "mark"])

    dealt = rows.repartitionById(buckets, "bucket") if "bucket" in rows.columns else rows.repartitionByRange(buckets, *order)
    found = common.cut(dealt.select(names).mapInArrow(run, schema))
    edges = found.where(F.col("mark").bitwiseAND(FIRST | LAST) != 0).select("bucket", *keys)

    def crossing(by, low, high):
        e = edges.groupBy(by).agg(F.min("bucket").alias(low), F.max("bucket").alias(high)).where(F.col(low) < F.col(high))
        return F.broadcast(e) if buckets <= BROADCAST_BUCKETS else e

    has = lambda bit: F.col("mark").bitwiseAND(bit) != 0
    is_so = lambda c: F.coalesce(c, F.lit(False))
    across = is_so((has(FIRST_RUN) & (F.col("core_low") < F.col("bucket"))) | (has(LAST_RUN) & (F.col("core_high") > F.col("bucket"))))
    before = is_so(has(FIRST_CLASS) & (F.col("all_low") < F.col("bucket")))
    after = is_so(has(LAST_CLASS) & (F.col("all_high") > F.col("bucket")))
    beside = found.join(crossing(keys[:1], "core_low", "core_high"), keys[:1], "left").join(crossing(keys, "all_low", "all_high"), keys, "left")
    return beside.where(has(REPEATED) | across).select(*names, (has(TWIN) | before | after).alias("twin"), (has(HEAD) & ~before).alias("head"), (has(MIXED) | across).alias("mixed"))
