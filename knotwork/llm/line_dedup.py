"""Line dedup [native]: range-partitioned line hashes, streamed first occurrences, compressed keep bitmaps.

A line's key is the line stripped of ASCII blanks with A-Z lower-cased. Keys of
at least ``min_chars`` code points found in two documents or more keep their
lines only in the smallest doc_id that holds them.

Defined cases: null or empty text is one empty line, which is never dropped;
a document that loses all its lines keeps the empty text; lines repeated within
one document are not duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Salts for a hot key, the share of sampled lines that makes a key hot, the documents sampled to find hot keys, and ranges of hashes a partition.
SALTS, HOT_SHARE, SAMPLE_DOCS, RANGES = 64, 0.002, 20_000, 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.btrim(common.lower_ascii(line), F.lit(common.BLANKS))


def line_rows(d: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (two hashes of the key), doc_id, pos for every line whose key is long enough."""
    return (
        d.select("doc_id", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "pos", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "pos")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, bitmap: for each document that loses lines, map<int, bigint> of 64-line words to the bits of dropped lines.

    The bitmap is compressed: words without a dropped line are absent.

    Line hashes are range-partitioned and sorted by hash, salt, document and position; the
    first row of a key is its first occurrence, which a running window hands to the rows
    after it. Hashes are spread evenly, so equal ranges of them need no sampled splitters. A
    hot key is dealt over SALTS ranges; the first occurrences of its salts, at most SALTS /
    HOT_SHARE rows, meet in a small aggregate. Which keys count as hot changes the speed only.
    """
    spark = docs.sparkSession
    d = common.texts(docs)
    n = common.partitions(spark)
    rows = line_rows(d, min_chars)
    share = min(1.0, SAMPLE_DOCS / max(1, d.count()))
    seen = line_rows(d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), min_chars).groupBy("h1").count()
    total = seen.agg(F.sum("count")).first()[0] or 0
    hot = [r.h1 for r in seen.where(F.col("count") >= max(50, HOT_SHARE * total)).select("h1").collect()]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    place = F.floor((F.shiftright("h1", 33) + (1 << 30)) * (RANGES * n) / (1 << 31)) + F.floor(F.col("salt") * (RANGES * n) / SALTS)
    key = ["range", "h1", "h2", "salt"]
    dealt = salted.withColumn("range", F.pmod(place, F.lit(RANGES * n)).cast("int")).repartition(n, "range").sortWithinPartitions(*key, "doc_id", "pos")
    w = Window.partitionBy(*key).orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = dealt.withColumn("first_doc", F.first("doc_id").over(w))
    bit = [F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit")]
    if hot:  # a salt's first document may still come after another salt's
        first = common.cut(first.where((F.col("doc_id") > F.col("first_doc")) | is_hot).select("h1", "h2", "doc_id", "pos", "first_doc"))
        open_ = first.where("doc_id = first_doc")
        heads = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
        late = open_.join(F.broadcast(heads), ["h1", "h2"]).where("doc_id > least").select("doc_id", *bit)
        gone = first.where("doc_id > first_doc").select("doc_id", *bit).union(late)
    else:
        gone = first.where("doc_id > first_doc").select("doc_id", *bit)
    words = gone.repartition("doc_id").groupBy("doc_id", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and kept (the text of the lines that stay) of docs with columns doc_id and text."""
    joined = docs.select("doc_id", "text").join(bitmaps, "doc_id", "left").withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("bitmap").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.expr("filter(lines, (l, i) -> coalesce((shiftright(bitmap[i >> 6], i & 63) & 1L) = 0, true))"), "\n"))
    dropped = F.coalesce(F.expr("aggregate(map_values(bitmap), 0L, (a, b) -> a + bit_count(b))"), F.lit(0).cast("long"))
    return joined.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: one row per document."""
    return apply_bitmaps(common.texts(docs), keep_bitmaps(docs, min_chars)).select("doc_id", "n_lines", "n_dropped", "kept")


def query(spark, sf_dir):
    out = line_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, i, ls[i] as line,
         trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents where doc_id is not null))
), first as (
  select key, min(doc_id) as first_doc from lines where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)
), marked as (
  select l.doc_id, l.i, l.line, coalesce(l.doc_id > f.first_doc, false) as gone from lines l left join first f using (key)
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
