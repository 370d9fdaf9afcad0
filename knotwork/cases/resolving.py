"""From mentions to entities, set by set: R1 to R8.

Mentions of one kind and name key are one; a key that nobody has numbered before
goes with the earliest key that is spelled almost alike; a document gathers what
bears it. The first document of a name takes its mentions without one; others
stay apart and are suggested. What counts as first is the mentions' ord, so that
the result doesn't depend on partitions.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..operators.ordered import placed
from . import lexicon as L
from .reading import PHASE

BY = ["case_id", "kind"]


class Resolved(NamedTuple):
    ids: DataFrame  # case_id, ord, id
    entities: DataFrame  # case_id, id, kind, label, aliases, review, doc, warning, ord
    names: DataFrame  # case_id, kind, key, first, id: what a name stands for, and since when
    suggestions: DataFrame  # case_id, a, b, reason


@F.pandas_udf(BooleanType())
def alike(new: pd.Series, old: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() >= r for a, b, r in zip(new, old, least)], dtype=bool)


#: Subsequences of one length that may be made of a key.
VARIANTS = 3000


def choices(of: str, among: str) -> Column:
    """How many subsequences of ``among`` letters a key of ``of`` letters has at most, as a double."""
    steps = F.sequence(F.lit(0), F.col(of) - F.col(among))
    return F.aggregate(steps, F.lit(1.0), lambda acc, i: F.when(i == 0, acc).otherwise(acc * (F.col(of) - i + 1) / i))


#: Variants of keys that a bucket of _meetings() holds, that a task keeps before it sends them on, and that are made at once.
BUCKET, HELD, MADE = 1 << 22, 1 << 21, 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(256)
def _dropped(n: int, common: int) -> np.ndarray:
    """The places before, at and after which letters go: a row for each choice of n - common places, from -1 to n."""
    some = list(combinations(range(n), n - common))
    return np.pad(np.array(some, dtype=np.int64).reshape(len(some), n - common), ((0, 0), (1, 1)), constant_values=((0, 0), (-1, n)))


def _hashed(keys: list[str], seeds: np.ndarray, common: int) -> np.ndarray:
    """A row for each key, all of one length: a hash of every subsequence of ``common`` letters; equal ones have equal hashes."""
    n = len(keys[0])
    letters = _mixed(np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32).reshape(len(keys), n).astype(np.uint64) + np.uint64(1))
    power = np.concatenate([[np.uint64(1)], np.full(n, _FACTOR)]).cumprod(dtype=np.uint64)
    upto = np.zeros((len(keys), n + 1), np.uint64)
    for i in range(n):
        upto[:, i + 1] = upto[:, i] * _FACTOR + letters[:, i]
    cut = _dropped(n, common)
    out = np.zeros((len(keys), len(cut)), np.uint64)
    for t in range(n - common + 1):  # the letters between one place and the next
        begin, end = cut[:, t] + 1, cut[:, t + 1]
        out += (upto[:, end] - upto[:, begin] * power[end - begin]) * power[common - (end - t)]
    return _mixed(out ^ seeds[:, None])


def _variants(buckets: int):
    """Of rows (id, seed, key, n, common): a row for each bucket of hashes, with the hashes' low halves and whose they are, packed."""

    def run(batches):
        held, count = [], 0

        def told():
            hashes, ids = (np.concatenate(c) for c in zip(*held))
            at = (hashes >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(at, kind="stable")
            hashes, ids, at = hashes[order].astype(np.uint32), ids[order], at[order]
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            cells = [(int(at[lo]), hashes[lo:hi].tobytes(), ids[lo:hi].tobytes()) for lo, hi in zip(begin, [*begin[1:], len(at)])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "ids"])

        for b in batches:
            keys, ids, seeds = b.column("key").to_pylist(), b.column("id").to_numpy().astype(np.uint32), b.column("seed").to_numpy().view(np.uint64)
            size, common = b.column("n").to_numpy(), b.column("common").to_numpy()
            order = np.lexsort((common, size))
            ends = np.flatnonzero((np.diff(size[order]) != 0) | (np.diff(common[order]) != 0)) + 1
            for some in np.split(order, ends):
                if not len(some):
                    continue
                n, m = int(size[some[0]]), int(common[some[0]])
                step = max(1, MADE // len(_dropped(n, m)))
                for lo in range(0, len(some), step):
                    part = some[lo : lo + step]
                    hashes = _hashed([keys[i] for i in part], seeds[part], m)
                    held.append((hashes.ravel(), np.repeat(ids[part], hashes.shape[1])))
                    count += hashes.size
                    if count > HELD:
                        yield told()
                        held, count = [], 0
        if held:
            yield told()

    return run


def _meetings(batches):
    """Of one bucket: a, b (a < b), each pair of keys that have a hash in common."""
    hashes, ids = [], []
    for b in batches:
        hashes += [np.frombuffer(x, np.uint32) for x in b.column("hashes").to_pylist()]
        ids += [np.frombuffer(x, np.uint32) for x in b.column("ids").to_pylist()]
    if not hashes:
        return
    both = (np.concatenate(hashes).astype(np.uint64) << np.uint64(32)) | np.concatenate(ids)
    del hashes, ids
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]  # a key may have one subsequence several ways
    at, step = np.arange(len(both)), 0
    while True:  # each with the next of its hash, then with the one after that
        step += 1
        at = at[at + step < len(both)]
        at = at[(both[at] ^ both[at + step]) >> np.uint64(32) == 0]
        if not len(at):
            return
        low = np.uint64(0xFFFFFFFF)
        pairs = np.unique(((both[at] & low) << np.uint64(32)) | (both[at + step] & low))
        for lo in range(0, len(pairs), HELD):
            some = pairs[lo : lo + HELD]
            yield pa.RecordBatch.from_arrays([pa.array((some >> np.uint64(32)).astype(np.int64)), pa.array((some & low).astype(np.int64))], ["a", "b"])


def spellings(keys: DataFrame, cut=lambda df: df) -> DataFrame:
    """case_id, kind, key, parent: the earliest earlier key that is spelled almost alike, for keys without a document at first.

    Two keys of n and m letters that are alike to a share r have a common subsequence of M = ceil(r (n + m) / 2)
    letters. Where neither has more than VARIANTS subsequences of M letters, hashes of all of them are made, packed, and
    sorted in buckets, which meets hardly anything but pairs that are alike, whatever words are frequent. For other lengths: keys differ in at
    most (1 - r) of their letters, so cut into one part more than that, the new key has a part that stands unchanged
    in the old one, at nearly the same place; pairs that share one and can't have M letters in common go at once.
    """
    likeness = F.when(F.col("kind") == "person", L.ALIKE["person"]).otherwise(L.ALIKE["company"])
    some = keys.where(F.col("kind").isin(*L.OWNERS) & (F.length("key") > 0)).withColumn("least", likeness).withColumn("n", F.length("key"))
    # the longer of two keys that are alike is at most 2 / r - 1 times as long
    some = some.withColumn("slack", (1 - F.col("least")) * 2 / F.col("least"))
    some = cut(placed(some, "id"))
    sizes = some.groupBy("kind", "least", "n").agg(F.count("*").alias("keys"))
    lengths_of = sizes.drop("keys")
    met = lengths_of.join(lengths_of.select("kind", F.col("n").alias("m")), "kind")
    met = met.withColumn("common", F.ceil(F.col("least") * (F.col("n") + F.col("m")) / 2 - 1e-9).cast("int")).where("common <= least(n, m)")
    met = cut(met.withColumn("by_variants", (choices("n", "common") <= VARIANTS) & (choices("m", "common") <= VARIANTS)))
    to_make = met.where("by_variants").select("kind", "n", "common").union(met.where("by_variants").select("kind", F.col("m").alias("n"), "common")).distinct()
    dealt = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what a key gives is much more than the key
    total = sizes.join(to_make, ["kind", "n"]).agg(F.sum(F.col("keys") * choices("n", "common"))).first()[0] or 0
    buckets = max(dealt, int(-(-total // BUCKET)))
    asked = some.select("case_id", "kind", "id", "key", "n").repartition(dealt, "id").join(F.broadcast(to_make), ["kind", "n"])
    made = asked.select("id", F.xxhash64("case_id", "kind", "common").alias("seed"), "key", "n", "common").mapInArrow(_variants(buckets), "bucket int, hashes binary, ids binary")
    pairs = made.repartitionById(buckets, "bucket").mapInArrow(_meetings, "a long, b long").distinct()
    of = lambda c: some.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in (*BY, "key", "first", "documented")])
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").where("case_id_a <=> case_id_b and kind_a = kind_b")
    later = lambda x: F.when(F.col("first_a") < F.col("first_b"), F.col(f"{x}_b")).otherwise(F.col(f"{x}_a"))
    short = pairs.where("first_a <> first_b").where(~later("documented"))
    short = short.select(F.col("case_id_a").alias("case_id"), F.col("kind_a").alias("kind"), later("key").alias("key"), F.when(F.col("first_a") < F.col("first_b"), F.col("key_a")).otherwise(F.col("key_b")).alias("old"), F.least("first_a", "first_b").alias("since"))
    # lengths whose subsequences would be too many
    others = met.where("not by_variants")
    rest = some.join(F.broadcast(others.select("kind", "n").union(others.select("kind", F.col("m").alias("n"))).distinct()), ["kind", "n"], "left_semi")
    pairs = _by_parts(rest).withColumns({"n": F.length("key"), "m": F.length("old")}).join(F.broadcast(others.drop("least", "by_variants")), ["kind", "n", "m"])
    pairs = pairs.where(F.levenshtein("key", "old") <= F.col("n") + F.col("m") - 2 * F.col("common")).select(*BY, "key", "old", "since").distinct()
    pairs = short.unionByName(pairs).withColumn("least", likeness)
    ends = (F.substring("key", 1, 1) == F.substring("old", 1, 1)) | (F.expr("right(key, 1)") == F.expr("right(old, 1)"))
    pairs = pairs.where(ends)
    return pairs.where(alike("key", "old", "least")).groupBy(*BY, "key").agg(F.min_by("old", "since").alias("parent"))


def _by_parts(some: DataFrame) -> DataFrame:
    """case_id, kind, key, old, since: an earlier key that holds a part of a key at nearly its place; pairs may come several times."""
    parts = lambda n: f"cast(floor(slack * ({n})) + 1 as int)"
    begin = lambda i, n: f"cast(floor({i} * ({n}) / {parts(n)}) as int)"
    new = some.where("not documented").selectExpr("case_id", "kind", "key", "first", "n", "least", "slack", f"explode(transform(sequence(0, {parts('n')} - 1), i -> struct({begin('i', 'n')} as at, substring(key, {begin('i', 'n')} + 1, {begin('(i + 1)', 'n')} - {begin('i', 'n')}) as part))) as p")
    new = new.select("case_id", "kind", "key", "first", "n", "least", "slack", "p.at", "p.part").where("part <> ''")
    lengths = f"array_distinct(flatten(transform(sequence(cast(floor(n * least / (2 - least)) as int), cast(ceil(n * (2 - least) / least) as int)), m -> if(m < 1, array(), array(cast(floor(m / {parts('m')}) as int), cast(ceil(m / {parts('m')}) as int))))))"
    old = some.selectExpr("case_id", "kind", "key as old", "first as since", "n as m", f"explode({lengths}) as size").where("size > 0 and size <= m")
    old = old.selectExpr("case_id", "kind", "old", "since", "m", "size", "explode(sequence(0, m - size)) as there").withColumn("part", F.expr("substring(old, there + 1, size)"))
    near = (F.col("since") < F.col("first")) & (F.abs(F.col("at") - F.col("there")) <= F.floor(F.col("slack") * F.greatest("n", "m"))) & (2 * F.least("n", "m") >= F.col("least") * (F.col("n") + F.col("m")) - 1e-9)
    ends = (F.substring("key", 1, 1) == F.substring("old", 1, 1)) | (F.expr("right(key, 1)") == F.expr("right(old, 1)"))
    return new.join(old, [*BY, "part"]).where(near & ends).select(*BY, "key", "old", "since")


def _roots(keys: DataFrame, parents: DataFrame, cut) -> DataFrame:
    """keys with root: parents followed to the end. A chain of spellings is short; each round halves what is left of it."""
    up = cut(parents)
    while up.limit(1).count():
        further = up.join(up.select(*BY, F.col("key").alias("parent"), F.col("parent").alias("next")), [*BY, "parent"], "left")
        if not further.where("next is not null").limit(1).count():
            break
        up = cut(further.select(*BY, "key", F.coalesce("next", "parent").alias("parent")))
    return keys.join(up, [*BY, "key"], "left").withColumn("root", F.coalesce("parent", "key")).drop("parent")


def resolve(mentions: DataFrame, cut=lambda df: df) -> Resolved:
    """mentions: case_id, ord, source, kind, label, number, key, doc, high; ords below reading.PHASE are those of reports.

    cut keeps a table that is read several times (a checkpoint, say).
    """
    m = mentions.select("case_id", "ord", "source", "kind", "label", "number", "key", "doc", "high")
    plain = m.where(F.col("kind").isin("phone", "email")).withColumn("id", F.concat_ws(":", "kind", F.coalesce("number", F.lower("label"))))
    named = m.where(~F.col("kind").isin("phone", "email"))
    has_doc = F.col("doc").isNotNull()
    numbered = F.concat_ws(":", "kind", "doc.kind", "doc.key")
    keys = cut(named.groupBy(*BY, "key").agg(F.min("ord").alias("first"), F.min_by(has_doc, "ord").alias("documented"), F.min_by("label", "ord").alias("label")))
    keys = cut(_roots(keys, spellings(keys, cut), cut))
    at = named.join(keys.select(*BY, "key", "root"), [*BY, "key"])
    docs = at.where(has_doc).withColumn("number", numbered)
    first_doc = cut(docs.groupBy(*BY, "root").agg(F.min_by("number", "ord").alias("of")))
    roots = keys.where("key = root").select(*BY, "root", F.when(F.col("root") != "", F.replace("root", F.lit(" "), F.lit("-"))).otherwise(F.concat(F.lit("~"), F.col("first").cast("string"))).alias("bare"))
    standing = cut(roots.join(first_doc, [*BY, "root"], "left").select(*BY, "root", F.coalesce("of", F.concat_ws(":", "kind", "bare")).alias("id")))
    named = cut(at.join(standing, [*BY, "root"]).withColumn("stands", F.col("id")).withColumn("id", F.when(has_doc, numbered).otherwise(F.col("id"))))

    text = F.col("ord") < PHASE
    own = named.where(F.col("key") == F.col("root"))
    named_ones = named.groupBy("case_id", "id", "kind").agg(
        F.max_by("label", F.when(has_doc, F.struct(F.col("label") != F.col("doc.text"), F.length("label"), "ord"))).alias("longest"),
        F.max_by("doc.text", F.when(has_doc, F.col("ord"))).alias("doc"),
        F.coalesce(F.bool_or(~F.col("doc.valid")), F.lit(False)).alias("warning"),
        F.bool_or("high").alias("high"),
        F.countDistinct(F.when(text, F.col("source"))).alias("sources"),
        F.min("ord").alias("ord"),
    )
    labels = own.where(~has_doc).groupBy("case_id", "id").agg(F.min_by("label", "ord").alias("earliest"))
    spelled = keys.join(standing, [*BY, "root"]).where("key <> root or not documented").groupBy("case_id", "id").agg(F.array_sort(F.collect_set("label")).alias("spelled"))
    full = named_ones.join(labels, ["case_id", "id"], "left").join(spelled, ["case_id", "id"], "left").withColumn("label", F.coalesce("longest", "earliest"))
    full = full.select(
        "case_id", "id", "kind", "label", F.array_remove(F.coalesce("spelled", F.array().cast("array<string>")), F.col("label")).alias("aliases"),
        ((F.col("kind") == "person") & F.col("doc").isNull() & ~F.col("high") & (F.col("sources") < 2)).alias("review"), "doc", "warning", "ord",
    )
    others = plain.groupBy("case_id", "id", "kind").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"))
    others = others.select("case_id", "id", "kind", "label", F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("review"), F.lit(None).cast("string").alias("doc"), F.lit(False).alias("warning"), "ord")
    names = keys.join(standing, [*BY, "root"]).select(*BY, "key", "first", "id")
    apart = named.where(has_doc & (F.col("id") != F.col("stands"))).select("case_id", F.col("stands").alias("a"), F.col("id").alias("b"), F.lit("same name, different documents").alias("reason"))
    suggestions = apart.unionByName(alike_names(keys.join(standing, [*BY, "root"])))
    suggestions = suggestions.where("a <> b").groupBy("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("reason").alias("reason"))
    return Resolved(named.select("case_id", "ord", "id").unionByName(plain.select("case_id", "ord", "id")), full.unionByName(others), names, suggestions)


def alike_names(keys: DataFrame) -> DataFrame:
    """case_id, a, b, reason: a name whose words are all among another's; persons with equal first and last words, organisations with two words or more.

    Only a key that made an entity of its own, without a document, is held against earlier ones. The
    side with fewer words looks for its two rarest of its case together (and a person for the first and the
    last word, too), so common words pair nothing.
    """
    k = keys.where(F.col("kind").isin(*L.OWNERS)).withColumn("words", F.array_distinct(F.split("key", " "))).withColumn("words", F.array_remove("words", ""))
    k = k.where(F.size("words") > 0).select(*BY, "key", "first", "words", "id", (F.col("key") == F.col("root")) & ~F.col("documented"))
    k = k.toDF(*BY, "key", "first", "words", "id", "fresh")
    each = k.select(*BY, "key", F.explode("words").alias("word"))
    person = F.col("kind") == "person"
    ends = F.when(person, F.concat_ws(" ", F.split("key", " +")[0], F.element_at(F.split("key", " +"), -1))).otherwise("")
    rarest = each.join(each.groupBy(*BY, "word").count(), [*BY, "word"]).groupBy(*BY, "key").agg(F.array_sort(F.collect_list(F.struct("count", "word"))).alias("ranked"))
    rarest = rarest.select(*BY, "key", F.array_join(F.array_sort(F.transform(F.slice("ranked", 1, 2), lambda x: x["word"])), " ").alias("word"))
    two = lambda w: F.concat(w, F.flatten(F.transform(F.array_sort(w), lambda x: F.transform(F.filter(w, lambda y: y > x), lambda y: F.concat_ws(" ", x, y)))))
    k = k.withColumn("ends", ends).where(person | (F.size(F.split("key", " +")) > 1))
    few = k.join(rarest, [*BY, "key"]).select(*BY, "ends", "word", *[F.col(c).alias(f"{c}_a") for c in ("key", "first", "words", "id", "fresh")])
    many = k.select(*BY, "ends", F.explode(two(F.col("words"))).alias("word"), *[F.col(c).alias(f"{c}_b") for c in ("key", "first", "words", "id", "fresh")])
    pairs = few.join(many, [*BY, "ends", "word"]).where("key_a <> key_b").where(F.size(F.array_except("words_a", "words_b")) == 0).where("if(first_a < first_b, fresh_b, fresh_a)")
    reason = F.when(F.col("kind") == "person", "same first and last name").otherwise("one name holds the other")
    return pairs.select("case_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), reason.alias("reason"))
