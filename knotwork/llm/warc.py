"""WARC: archives written as splittable files and read back by boundary-chain verification.

Writing: a record per page, uncompressed; of pages with equal payloads the one
with the largest page_id is a response, the others are revisits that name it
and keep the digest and, in their HTTP header, the size of the payload.

Reading: files are split anywhere and cut at every magic ``WARC/1.``, also at
those inside payloads. A cut piece whose header gives a length is a candidate:
it emits its own offset and its successor's. Each block follows its candidates
to the first offset beyond the block; pointer jumping over these few entries,
from the start of each file, marks the blocks' true entries, and a last walk
inside each block marks the records reached. Whatever is not reached lies
inside a payload and goes back into it.

Defined cases: pages without a page_id are left out; null html is the empty
payload; of rows that share a page_id the one with the smallest html counts
(null before any); empty payloads are equal payloads like others; blanks and
control bytes of a URL become %20, a null one leaves its header out. An empty
table gives no files and no records. Payloads of any length and any bytes come
back unchanged, one row each. A record that a file ends within is returned with
``whole`` false; what follows a broken record in its file is not reached. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format.
MAGIC, BREAK, PROFILE = "WARC/1.", "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file at most; larger archives have more files.
FILE_RECORDS = 100_000


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: five hexadecimal digits give four of base 32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), BASE32_HEX, BASE32)


def _pages(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).where("page_id is not null")
    if p.groupBy("page_id").count().where("count > 1").limit(1).count():
        p = p.groupBy("page_id").agg(F.min(F.struct(F.col("html").isNotNull().alias("has"), "html", "url")).alias("s")).select("page_id", "s.url", "s.html")
    return p.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record for each page to files in folder. Payloads of fewer than ``least`` bytes are never revisits."""
    p = _pages(pages).withColumn("digest", base32_sha1(F.col("payload")))
    equal = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    held = p.join(common.small(common.cut(equal)), "digest", "left")
    again = (F.octet_length("payload") >= least) & (F.col("kept") > F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length("payload").cast("string")), F.lit("\r\n"))
    body = F.when(again, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    target = F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit(""))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        target,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("kept"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    # the writer of texts puts bytes as they are and ends each row with the last byte of a record
    record = F.concat(head.cast("binary"), F.col("body"), F.lit("\r\n\r").cast("binary")).cast("string")
    held.withColumn("body", body).select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _field(head: Column, name: str, value: str = r"[^\r\n]*?") -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*({value})[ \t]*$", 1)
    return F.when(found != "", found)


def _header(piece: Column) -> Column:
    """What stands before the first empty line; null without one."""
    return F.when(F.instr(piece, BREAK) > 0, F.substring_index(piece, BREAK, 1))


def _cut(spark: SparkSession, source: str, at: str) -> DataFrame:
    """Cut the files of source at each magic, into a table at ``at``: file, block (where its split begins), row, piece, n (bytes), span (bytes of its record by its header)."""
    rows = spark.read.option("lineSep", MAGIC).text(source)
    p = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece"))
    head = F.when(F.col("piece").rlike(r"\A[0-9]\r\n"), _header(F.col("piece")))
    p = p.withColumn("n", F.octet_length("piece").cast("long")).withColumn("_head", head)
    span = len(MAGIC) + F.octet_length("_head").cast("long") + len(BREAK) + _field(F.col("_head"), "content-length", "[0-9]{1,15}").cast("long") + len(BREAK)
    p.withColumn("span", span).drop("_head").write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def candidates(pieces: DataFrame) -> DataFrame:
    """file, block, row, start, next (the successor's offset; null where no header gives one), end (of the piece).

    Offsets are prefix sums: inside a block, which is as large as a split at most, and over the blocks of a file.
    """
    step = F.col("n") + len(MAGIC)
    inner = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    p = pieces.select("file", "block", "row", "n", "span")
    sums = p.groupBy("file", "block").agg(F.sum(step).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = p.withColumn("inside", F.coalesce(F.sum(step).over(inner), F.lit(0))).join(sums.select("file", "block", "before"), ["file", "block"])
    start = F.col("before") + F.col("inside") - len(MAGIC)
    return placed.select("file", "block", "row", start.alias("start"), (start + F.col("span")).alias("next"), (start + len(MAGIC) + F.col("n")).alias("end"))


def _exits(block):
    """Of a block's candidates: the first offset beyond the block that following them leads to, and the record it is reached from."""
    block = block.sort_values("start")
    exits, last = {}, {}
    for start, following in zip(block["start"].tolist()[::-1], block["next"].tolist()[::-1]):
        if following == following and following is not None:
            exits[start], last[start] = (exits[following], last[following]) if following in exits else (int(following), start)
    import pandas as pd

    return pd.DataFrame({"file": block["file"].iloc[0], "block": block["block"].iloc[0], "start": list(exits), "exit": list(exits.values()), "last": list(last.values())})


def _walk(block):
    """Of a block's pieces: the start of the record reached that each lies in; null before the block's entry."""
    block = block.sort_values("start")
    at, owner, owners = block["entry"].iloc[0], None, []
    for start, following in zip(block["start"].tolist(), block["next"].tolist()):
        if start == at:
            owner, at = start, following
        owners.append(owner)
    import pandas as pd

    return pd.DataFrame({"file": block["file"], "block": block["block"], "row": block["row"], "start": block["start"], "end": block["end"], "owner": pd.array(owners, "Int64")})


def entries(c: DataFrame) -> DataFrame:
    """file, block, entry, last: where the chain from each file's start enters its blocks, and the record it leaves them from."""
    exits = common.cut(c.groupBy("file", "block").applyInPandas(_exits, "file string, block long, start long, exit long, last long"))
    targets = exits.select("file", F.col("exit").alias("start")).union(exits.select("file", F.lit(0).cast("long").alias("start"))).distinct()
    open_ = common.cut(exits.join(targets, ["file", "start"]))
    reached, known = common.cut(open_.where("start = 0").select("file", "start")), -1
    jump = open_.select("file", "start", "exit")
    while (n := reached.count()) > known:
        known = n
        further = reached.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start")).join(open_.select("file", "start"), ["file", "start"])
        reached = common.cut(reached.union(further).distinct())
        jump = common.cut(jump.join(jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond")), ["file", "exit"]).select("file", "start", F.col("beyond").alias("exit")))
    return open_.join(reached, ["file", "start"]).select("file", "block", F.col("start").alias("entry"), "last")


def owners(c: DataFrame) -> DataFrame:
    """file, row, start, end, owner: the start of the reached record that each piece begins or lies in; null before any."""
    c = common.cut(c)
    into = common.cut(entries(c))
    own = c.join(into.select("file", "block", "entry"), ["file", "block"], "left").groupBy("file", "block").applyInPandas(_walk, "file string, block long, row long, start long, end long, owner long")
    blocks = c.select("file", "block").distinct().join(into.select("file", "block", "last"), ["file", "block"], "left")
    carried = blocks.select("file", "block", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return own.join(carried, ["file", "block"]).select("file", "row", "start", "end", F.coalesce("owner", "carried").alias("owner"))


def read(spark: SparkSession, source: str, scratch: str) -> DataFrame:
    """record_id, record_type, target_uri, payload_digest, refers_to, http (the HTTP header), payload (binary), whole: the records of the files in source.

    Two tables are written under scratch, a folder that all executors share. Payloads are shuffled only where a magic inside them cut them.
    """
    pieces = _cut(spark, source, f"{scratch}/pieces")
    owned = owners(candidates(pieces))
    parts = F.count("*").over(Window.partitionBy("file", "owner"))
    odd = common.cut(owned.withColumn("parts", parts).where("owner is null or parts > 1").select("row", "file", "owner"))
    plain = pieces.join(common.small(odd.select("row")), "row", "left_anti").select("piece")
    cut = pieces.select("row", "piece").join(common.small(odd.where("owner is not null")), "row").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("row", "piece"))).alias("parts"))
    whole = plain.union(cut.select(F.expr(f"array_join(transform(parts, p -> p.piece), '{MAGIC}')")))
    head = whole.withColumn("head", _header(F.col("piece"))).where("head is not null")
    length, offset = _field(F.col("head"), "content-length", "[0-9]{1,15}").cast("long"), F.octet_length("head") + len(BREAK)
    raw = F.col("piece").cast("binary")
    body = head.withColumns({"length": length, "body": F.substring(raw, offset + 1, length.cast("int")).cast("string")})
    http = F.when(F.instr("body", BREAK) > 0, F.substring_index("body", BREAK, 1)).otherwise("")
    return body.withColumn("http", http).select(
        _field(F.col("head"), "warc-record-id").alias("record_id"),
        _field(F.col("head"), "warc-type").alias("record_type"),
        _field(F.col("head"), "warc-target-uri").alias("target_uri"),
        F.regexp_replace(_field(F.col("head"), "warc-payload-digest"), "^sha1:", "").alias("payload_digest"),
        _field(F.col("head"), "warc-refers-to").alias("refers_to"),
        "http",
        F.substring(F.col("body").cast("binary"), F.octet_length("http") + len(BREAK) + 1, F.octet_length("body")).alias("payload"),
        (F.octet_length("body") == F.col("length")).alias("whole"),
    )


def query(spark, sf_dir):
    folder = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/files")
    records = read(spark, f"{folder}/files", folder)
    number = lambda urn: F.regexp_extract(urn, "<urn:page:(-?[0-9]+)>", 1).cast("long")
    again = F.col("record_type") == "revisit"
    out = records.select(
        number("record_id").alias("page_id"),
        F.when(again, _field(F.col("http"), "content-length", "[0-9]+").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.col("payload_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type",
        F.when(again, number("refers_to")).alias("refers_to"),
    )
    return common.cut(out)


SQL = r"""
with p as (
  select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex, html
  from (select page_id, min(coalesce(html, '')) as html from pages where page_id is not null group by page_id)
), kept as (
  select html, max(page_id) as kept from p group by html
)
select page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), 'string_agg', '') as payload_digest,
       case when kept = page_id then 'response' else 'revisit' end as record_type,
       case when kept <> page_id then kept end as refers_to
from p join kept using (html)
"""
