"""Conversation prefix trie: shared beginnings of conversations as one tree.

Every distinct sequence of a conversation's first d turns is a node of depth d,
below the textless root. Prefixes are named by two 64-bit digests, the
exclusive or of a hash of each turn with its place, so a prefix sum makes them
all at once. A node belongs to the smallest conversation that starts with it.
What a conversation owns is a suffix of its depths, for members only get fewer
on the way down, so its first owned depth is found by binary search: each round
joins the digest at every conversation's middle depth against the smallest
conversation of that digest. The owned depths of a conversation are a chain,
chains hang from nodes of other chains, and totals of subtrees are summed over
that tree of chains by doubling: a round adds what hangs twice as far below.

Defined cases: rows without a conv_id are left out; null roles and texts are
empty; turns without a number come first; turns of equal number are ordered by
role and then by the SHA-256 of the text; repeated rows are turns of their own.
A conversation without turns is a member of the root alone. A table without
conversations gives no rows. Texts of any length travel as their SHA-256 and
size. Of a conversation or a beginning that holds most rows, turns are dealt
over all tasks (``operators.ordered``). The trie's height costs logarithmically
many rounds. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running
from . import common

#: A chain's own columns that are summed over the chains below it.
TOTALS = ("leaves", "saved")
#: Conversation numbers gathered in one row on the way to a node's digest.
PIECE = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, print (SHA-256 of the text), size (bytes of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("print"), F.octet_length(text).cast("long").alias("size"))
    out = running(t.where("conv_id is not null"), ["conv_id"], ["turn", "role", "print"], add={"place": F.lit(1)})
    return common.cut(out.select("conv_id", (F.col("place") - 1).alias("place"), "role", "print", "size"))


def rebuilt(own: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns) and turns (conv_id, depth from 1, role, print, size) that the contract derives.

    Conversation c starts with the first h turns of c - c % every, h being crc32 of c modulo ``modulus``; its own turns after its first h follow.
    """
    head, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus, F.col("conv_id") - F.col("conv_id") % every
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumns({"head": head, "base": base})
    found = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    lent = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = common.cut(found.withColumn("lent", lent).select("conv_id", "base", "head", "lent", (F.col("lent") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))).alias("n_turns")))
    kept = own.join(convs, "conv_id").where("place >= head").select("conv_id", (F.col("place") - F.col("head") + F.col("lent") + 1).alias("depth"), "role", "print", "size")
    first = own.where(F.col("place") < modulus - 1).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.select("conv_id", "base", "head"), "base").where("place < head").select("conv_id", (F.col("place") + 1).alias("depth"), "role", "print", "size")
    return convs.select("conv_id", "n_turns"), kept.unionByName(taken)


def _searched(convs: DataFrame, prefixes: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, n_turns, first (its smallest owned depth, n_turns + 1 if it owns none), parent (the owner of the node above; null above the root)."""
    probes = convs.select("conv_id", "n_turns", F.lit(0).cast("long").alias("low"), (F.col("n_turns") + 1).alias("high"), F.lit(None).cast("long").alias("parent"))
    digest = ["depth", "d1", "d2"]
    while True:
        # the owner of depth low - 1 is known (parent); an owner below high is the conversation itself
        middle = probes.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        asked = middle.where("low < high").join(prefixes.select("conv_id", *digest), ["conv_id", "depth"]).join(minima.select(*digest, "owner"), digest)
        mine = F.col("owner") == F.col("conv_id")
        moved = asked.select("conv_id", "n_turns", F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        probes = common.cut(moved.union(probes.where("low >= high")))
        if probes.where("low < high").limit(1).count() == 0:
            return probes.select("conv_id", "n_turns", F.col("low").alias("first"), "parent")


def _summed_below(chains: DataFrame) -> DataFrame:
    """conv_id and TOTALS of each chain (conv_id, parent, TOTALS) with those of all chains below it.

    After k rounds a chain holds the sums of chains less than 2**k steps below it and knows its 2**k-th chain above.
    """
    held = chains.select("conv_id", F.col("parent").alias("above"), *TOTALS)
    while held.where("above is not null").limit(1).count():
        below = held.where("above is not null").groupBy("above").agg(*[F.sum(c).alias(f"more_{c}") for c in TOTALS]).withColumnRenamed("above", "conv_id")
        up = held.select(F.col("conv_id").alias("above"), F.col("above").alias("higher"))
        jumped = held.join(below, "conv_id", "left").join(up, "above", "left")
        held = common.cut(jumped.select("conv_id", F.col("higher").alias("above"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in TOTALS]))
    return held.drop("above")


def _end_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the digest of each node's conv_ids, ascending and joined by commas.

    Numbers are ordered over ranges and joined to pieces of PIECE; a digest then takes its pieces one after another, so a node
    where a third of all conversations end is no row and no list.
    """
    placed = running(ends, ["owner", "depth"], ["conv_id"], add={"n": F.lit(1)})
    piece = F.floor((F.col("n") - 1) / PIECE)
    pieces = placed.groupBy("owner", "depth", piece.alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("text"))
    n = common.partitions(ends.sparkSession)

    def run(batches):
        import pyarrow as pa

        def row(key, digest):
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["owner", "depth", "ends_sha256"])

        key = digest = None
        for batch in batches:
            done = []
            for owner, depth, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, depth) != key:
                    if key is not None:
                        done.append(row(key, digest))
                    key, digest = (owner, depth), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key is not None:
            yield row(key, digest)

    common.bounded_batches(ends.sparkSession)
    dealt = pieces.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "piece")
    return dealt.select("owner", "depth", "text").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, n_turns) with turns (conv_id, depth, role, print, size): the contract's columns."""
    values = {f"d{k}": F.xxhash64(F.lit(k), "depth", "role", "print") for k in (1, 2)}
    placed = running(rows, ["conv_id"], ["depth"], xor=values).select("conv_id", "depth", "d1", "d2", "size")
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "d1", "d2", "size")])
    prefixes = common.cut(placed.unionByName(root))
    minima = common.cut(prefixes.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("size").alias("size")))

    searched = common.cut(_searched(convs, prefixes, minima))
    chains = searched.where("first <= n_turns")
    hung = chains.where("first > 0").groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved")).join(hung, ["owner", "depth"], "left")
    nodes = nodes.join(chains.select(F.col("conv_id").alias("owner"), "n_turns", "first", "parent"), "owner")
    on = F.col("depth") < F.col("n_turns")
    n_children = F.coalesce("hung", F.lit(0)) + on.cast("long")
    nodes = common.cut(nodes.select("owner", "depth", F.when(F.col("depth") > F.col("first"), F.col("owner")).when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", n_children.alias("n_children"), "saved", (n_children == 0).cast("long").alias("leaves")))

    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(*[F.sum(c).alias(c) for c in TOTALS])
    totals = _summed_below(common.cut(chains.join(own, "conv_id").select("conv_id", "parent", *TOTALS)))
    below = chains.where("first > 0").join(totals, "conv_id").groupBy(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")).agg(*[F.sum(c).alias(f"hung_{c}") for c in TOTALS])
    sums = {c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in TOTALS}
    summed = running(nodes.join(below, ["owner", "depth"], "left").withColumns(sums).withColumn("up", -F.col("depth")), ["owner"], ["up"], add={f"n_{c}": F.col(c) for c in TOTALS})

    # where a conversation ends: at its own node, or, if it owns none, at the node whose owner the search saw last
    ends = searched.select(F.when(F.col("first") <= F.col("n_turns"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("n_turns").alias("depth"), "conv_id")
    digests = _end_digests(ends)
    out = summed.join(digests, ["owner", "depth"], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves"), F.col("n_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir):
    return trie(*rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = r"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, unhex(sha256(text))) - 1 as place, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
), heads as (  -- crc32 of the decimal number, bit by bit
  select conv_id, conv_id - conv_id % 5 as base,
         xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint),
             lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295), 4294967295) % 9 as h
  from (select distinct conv_id from own)
), turns as (
  select h.conv_id, 0 as part, o.place, {'role': o.role, 'text': o.text} as turn from heads h join own o on o.conv_id = h.base where o.place < h.h
  union all
  select h.conv_id, 1, o.place, {'role': o.role, 'text': o.text} from heads h join own o using (conv_id) where o.place >= h.h
), whole as (
  select h.conv_id, coalesce(t.turns, []) as turns
  from heads h left join (select conv_id, list(turn order by part, place) as turns from turns group by conv_id) t using (conv_id)
), prefixes as (
  select conv_id, d, turns[1:d] as prefix, d = len(turns) as ends from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from whole)
), nodes as (
  select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, case when d = 0 then 0 else (count(*) - 1) * strlen(prefix[d].text) end as saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from prefixes group by prefix, d
), children as (
  select prefix[1:d - 1] as prefix, count(*) as n from nodes where d > 0 group by all
), full_nodes as (
  select n.*, coalesce(c.n, 0) as n_children, p.conv_id as parent_conv_id
  from nodes n left join children c using (prefix) left join nodes p on n.d > 0 and p.prefix = n.prefix[1:n.d - 1]
), sums as (
  select prefix, sum(saved) as saved, sum((n_children = 0)::int) as leaves
  from (select f.prefix[1:k] as prefix, f.saved, f.n_children from full_nodes f, lateral (select unnest(range(0, f.d + 1)) as k)) group by prefix
)
select f.conv_id, f.d::bigint as depth, f.parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children,
       s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, f.ends_sha256
from full_nodes f join sums s using (prefix)
"""
