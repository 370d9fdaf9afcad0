"""What several operators share: reading, word splitting, cutting lineage."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it.
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. A local session may do without: it gets a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared checkpoint folder, so that lost executors don't lose it."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes of texts handed to Python at a time. Spark's default, 10,000 rows of up to 64 MB in all, would fill an executor's memory beside its heap.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set BATCH_BYTES for this session, unless its user has set another bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only. Of rows that share a doc_id the one with the smallest text counts (null before any text).

    Whether any id repeats is found on the ids alone; only then are texts shuffled for it.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if d.groupBy("doc_id").count().where("count > 1").limit(1).count():
        d = d.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text")).alias("s")).select("doc_id", F.col("s.text").alias("text"))
    return d


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class SpanHash:
    """Hashes of any span of a sequence in constant time: prefix sums of value * M**i modulo 2**64, shifted back by M**-start."""

    M = 0x9E3779B97F4A7C15 | 1
    power = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.power) < n + 1:
            n = max(n, 2 * len(cls.power))
            for name, base in (("power", cls.M), ("inverse", pow(cls.M, -1, 1 << 64))):
                full = np.full(n + 1, base, np.uint64)
                full[0] = 1
                setattr(cls, name, np.multiply.accumulate(full))

    def __init__(self, values: np.ndarray):
        self.grow(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def per_text(docs: DataFrame, schema: str, start, chars: int = 1 << 20) -> DataFrame:
    """One row per document, made from its own text alone, without a shuffle.

    start() runs once in each task and returns a function from a list of texts
    (never null) to a dict of columns. Texts are handed over in slices of about
    ``chars`` characters, so a task's memory doesn't grow with its input. Rows
    that repeat a doc_id give as many rows.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    bounded_batches(docs.sparkSession)
    full = _parse_datatype_string(f"doc_id long, {schema}")
    assert isinstance(full, StructType)

    def run(batches):
        made, arrow = start(), to_arrow_schema(full)

        def flush(ids, texts):
            columns = made(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())] + [pa.array(columns[f.name], f.type) for f in list(arrow)[1:]], schema=arrow)

        ids, held, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                held.append(text := t.as_py())
                size += len(text)
                if size >= chars:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield flush(ids, held)

    return d.mapInArrow(run, full)


#: Ids (rows of a long or two) up to which one side of a join with documents is broadcast; beyond it the join shuffles.
SMALL_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """df, which holds nothing but ids, marked for broadcast if it has few rows (df should be cut, as it is counted)."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


#: Which bytes only separate words: ASCII blanks; for letters, digits and everything beyond ASCII, all other ASCII.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(raw: bytes, breaks: np.ndarray = BLANK) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order, without making a string of each."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~breaks[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return SpanHash(BYTE_VALUES[b]).spans(edges[::2], edges[1::2])
