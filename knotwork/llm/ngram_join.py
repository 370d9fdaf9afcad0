"""N-gram Jaccard join: a grouped prefix join.

A document's set holds its distinct shingles of five words. All shingles have
one order, rare before frequent, and two sets that reach the threshold share a
shingle among their first n - ceil(0.8 n) + 1. Documents with the same prefix and
size collapse into one group; equal sets become one node. Prefix shingles that
two groups hold give candidates, filtered by size and by what the shingle's
places leave possible. Candidates are verified on the exact sets.

Links are wanted for their components, so candidates come in two steps: each
node is first held against the node that leads most of its shingles (the one
with the fewest rarer shingles); then only nodes of different components are
paired. Members that already hang together are never paired with each other.

Which shingles count as frequent comes from a bounded sample of documents. Any
order gives the same links; this one only makes few candidates.

Defined cases: null texts and texts without words have no shingles and link to
nothing; with fewer than five words the whole sequence is the one shingle; of
rows sharing a doc_id the one with the smallest text counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sorted_runs import buckets_for, repeated

#: Documents sampled to find frequent shingles, and most frequent shingles kept.
SAMPLE_DOCS, FREQUENT = 16_384, 1 << 18
#: Nodes of a token that are paired with each other in one key.
BLOCK = 512
K, NUM, DEN = 5, 4, 5
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    w = common.word_hashes(text.encode().lower())  # lowers A-Z only: these are bytes
    if len(w) == 0:
        return w
    if len(w) < K:
        return common.mixed(common.SpanHash(w).spans(np.array([0]), np.array([len(w)])) + np.uint64(len(w)))
    s = w[: len(w) - K + 1] * ODD[0]
    for j in range(1, K):
        s = s + w[j : len(w) - K + 1 + j] * ODD[j]
    return np.unique(common.mixed(s))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of about eight bits a shingle; its length is a power of two."""
    bits = np.zeros(1 << (8 * len(s) - 1).bit_length(), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_link(na: int, nb: int, a: bytes, b: bytes) -> bool:
    """False only if the bitmaps prove too many shingles to be in one set alone; never false for a link."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    least = -(-NUM * (na + nb) // (NUM + DEN))
    return int(np.bitwise_count(x & ~y).sum()) <= na - least and int(np.bitwise_count(y & ~x).sum()) <= nb - least


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def frequent_shingles(d: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their ranks, from 1 with the least frequent; at most FREQUENT."""
    import pyarrow as pa

    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text or "").view(np.int64))], names=["s"])

    sampled = d.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    top = sampled.mapInArrow(run, "s long").groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()
    s = top["s"].to_numpy(np.int64).view(np.uint64)[::-1]  # least frequent first
    order = np.argsort(s)
    return s[order], order + 1


def sets(d: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, one, two (names of the set), grp (name of prefix and size), prefix, sketch. The result is cut."""
    shared = d.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT entries

    def start():
        known, ranks = shared.value

        def one(text):
            s = shingles(text)
            n = len(s)
            if n == 0:
                return 0, 0, 0, 0, s.view(np.int64), b""
            rank = np.zeros(n, np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                rank = np.where(known[at] == s, ranks[at], 0)
            p = s[np.argsort(rank, kind="stable")[: prefix_size(n)]]
            grp = common.SpanHash(p).spans(np.array([0]), np.array([len(p)]))
            return n, int(common.mixed(s).sum().view(np.int64)), int(common.mixed(s * ODD[1]).sum().view(np.int64)), int(grp.view(np.int64)[0]), p.view(np.int64), sketch(s)

        def made(texts):
            return dict(zip(("n", "one", "two", "grp", "prefix", "sketch"), zip(*map(one, texts))))

        return made

    out = common.cut(common.per_text(d, "n long, one long, two long, grp long, prefix array<long>, sketch binary", start))
    shared.unpersist()
    return out


def _beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The pairs a, b with both documents' columns."""
    for c in "ab":
        pairs = pairs.join(rows.select(F.col("doc_id").alias(c), *[F.col(x).alias(x + c) for x in columns]), c)
    return pairs


def _of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of documents that are in a pair."""
    ids = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    return rows.join(common.small(ids), "doc_id", "left_semi")


def verified(pairs: DataFrame, base: DataFrame, d: DataFrame) -> DataFrame:
    """The pairs a, b whose sets reach the threshold: bitmaps rule out most of the others, exact sets decide.

    Only documents of pairs that the bitmaps leave are read again, and each is cut into shingles once.
    """

    common.bounded_batches(d.sparkSession)

    def ruled(frames):
        for f in frames:
            yield f[[may_link(*x) for x in zip(f["na"], f["nb"], f["sketcha"], f["sketchb"])]][["a", "b"]]

    left = common.cut(_beside(pairs, _of(pairs, base.select("doc_id", "n", "sketch")), "n", "sketch").mapInPandas(ruled, "a long, b long"))
    exact = common.per_text(_of(left, d), "shingles array<long>", lambda: lambda texts: {"shingles": [shingles(t).view(np.int64) for t in texts]})

    def decided(frames):
        for f in frames:
            yield f[[linked(s, t) for s, t in zip(f["shinglesa"], f["shinglesb"])]][["a", "b"]]

    return _beside(left, exact, "shingles").mapInPandas(decided, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link: least labels, with pointers halved."""
    edges = common.cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = common.cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        moved = common.cut(stepped.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"), "was"))
        labels = moved.select("node", "component")
        if not moved.where("component <> was").limit(1).count():
            return labels


def _possible(na, nb, pa, pb):
    """Whether sizes and the places of a shared shingle leave the threshold possible; true for a pair's first shared shingle if the pair links."""
    least = F.ceil(NUM * (na + nb) / F.lit(float(NUM + DEN)) - 1e-9)
    return (DEN * na >= NUM * nb) & (DEN * nb >= NUM * na) & (F.least(na - pa, nb - pb) >= least)


def _across(mixed: DataFrame) -> DataFrame:
    """The pairs of nodes that share a token and lie in different components.

    A token's nodes are dealt over blocks of about BLOCK; each pair of blocks is a key of its own,
    so no task pairs all nodes of a frequent token.
    """
    blocks = mixed.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = mixed.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda s, one, two: dealt.withColumn("other", other).select("token", F.col("own").alias(one), F.col("other").alias(two), *[F.col(c).alias(c + s) for c in ("node", "n", "pos", "component")])
    return side("x", "p", "q").join(side("y", "q", "p"), ["token", "p", "q"]).where("componentx < componenty")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document."""
    d = common.texts(docs)
    frequent = frequent_shingles(d, d.count())
    base = sets(d, frequent)
    full = base.where("n > 0")
    groups = full.groupBy("grp", "n").agg(F.min("doc_id").alias("gid"), F.any_value("prefix").alias("prefix"))
    rows = groups.select("gid", "n", F.posexplode_outer("prefix").alias("pos", "token")).select("token", "gid", "n", F.col("pos").cast("long").alias("pos"))
    estimate = full.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = repeated(rows, ["token"], ["gid"], buckets_for(d.sparkSession, estimate))
    nodes = common.cut(full.groupBy("grp", "n", "one", "two").agg(F.min("doc_id").alias("node")))
    members = nodes.join(nodes.groupBy("grp", "n").agg(F.min("node").alias("gid")), ["grp", "n"]).select("gid", "node", "n")
    wide = members.groupBy("gid").count().where("count > 1").select("gid")
    inside = members.join(wide, "gid").select(F.xxhash64("gid", F.lit(9)).alias("token"), "node", "n", F.lit(0).cast("long").alias("pos"))
    places = common.cut(shared.select("token", "gid", "pos").join(members, "gid").select("token", "node", "n", "pos").unionByName(inside))

    lead = places.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("l"))
    led = places.join(lead, "token").where(F.col("node") != F.col("l.node")).where(_possible(F.col("n"), F.col("l.n"), F.col("pos"), F.col("l.pos")))
    votes = led.groupBy("node", F.col("l.node").alias("leader")).count()
    first = common.cut(votes.groupBy("node").agg(F.max(F.struct("count", -F.col("leader"))).alias("m")).select(F.least("node", -F.col("m.col2")).alias("a"), F.greatest("node", -F.col("m.col2")).alias("b")).distinct())
    links = common.cut(verified(first, base, d))
    now = components(links)

    labelled = places.join(now, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    mixed = labelled.join(split, "token")
    across = _across(mixed).where(_possible(F.col("nx"), F.col("ny"), F.col("posx"), F.col("posy")))
    second = across.select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = common.cut(verified(common.cut(second), base, d))
    final = components(links.union(more))

    of = nodes.join(final, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component"))
    found = base.select("doc_id", "n", "one", "two").join(of, ["one", "two", "n"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir):
    return jaccard_components(common.documents(spark, sf_dir))
