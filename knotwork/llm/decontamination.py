"""Benchmark decontamination [native]: spaced-seed hashing.

Fixed masks look at some words of a window and ignore the others, so a seed
survives substitutions at the ignored places. A sieve of the word pairs that masks
begin with keeps words that begin no item's seed from giving any. Seeds of documents and of
benchmark items are joined on their hash; around each hit the two texts are
laid side by side (same diagonal: document position minus item position) and
equal words are noted by their place in the item. An item is found in a document
when the places that agree on the hit diagonals of one stretch of the document
reach ``min_share`` of the item. A stretch takes in diagonals up to an item's
length apart, so an item quoted in parts counts, while the chance hits of a long
document don't add up; a place that agrees on several diagonals counts once.

Masks go by an item's length, so that at least nine in ten items with half of
their words replaced at random keep a seed, whatever their length from SPAN words
on; masks of lengths that no item has are not applied. Items of fewer than SPAN
words have one seed, of all their words: they are found where they stand whole.

Defined cases: null or empty texts and items match nothing; repeated items count
once each under their own item_id; null item_ids are left out; of rows sharing an
item_id each counts, and the pair's best match stands; of rows sharing a doc_id
the one with the smallest text counts. A text of any length is one row of hashes
and is laid beside an item around its hits only. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The word offsets that each mask looks at: of items from LONG words on, and of those from SPAN to LONG words, which have fewer
#: places for a mask and so get lighter ones. Found by search for the least recall over all lengths, at half of the words kept.
MASKS = ((0, 1, 2, 4), (0, 1, 5, 7), (0, 1, 8, 9), (0, 1, 10, 11), (0, 2, 5, 6), (0, 3, 5, 6))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3))
SPAN, LONG = 9, 15
#: 64-bit numbers up to which a side is broadcast (16 MB); beyond them the join shuffles.
BROADCAST_LONGS = 2_000_000
#: Bits of a sieve of word pairs (32 KB a distance).
SLOTS = 1 << 18
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n words."""
    return MASKS if n >= LONG else SHORT_MASKS if n >= SPAN else (tuple(range(n)),)


def word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """array<bigint> of the hashes of the words, A-Z lower-cased; ASCII punctuation and blanks only separate."""
    words = F.split(common.lower_ascii(F.coalesce(F.col(text), F.lit(""))), BREAKS, -1)
    return df.withColumn(out, F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _by_pair(masks) -> dict[int, list[tuple[int, ...]]]:
    """Masks by the distance of their first two words (0 for masks of one word)."""
    out: dict[int, list[tuple[int, ...]]] = {}
    for m in dict.fromkeys(masks):
        out.setdefault(m[1] if len(m) > 1 else 0, []).append(m)
    return out


def _pair(hashes: str, d: int) -> str:
    return f"xxhash64({d}, {hashes}[i], {hashes}[i + {d}])"


def sieves(items: DataFrame, hashes: str, masks) -> dict[int, str]:
    """For each distance of _by_pair an array literal of SLOTS bits in longs: whether two words of an item so far apart have that slot.

    A pair's hash gives the long, its second word's hash the bit. Only slots reach the driver, so at most SLOTS rows a distance;
    a benchmark that fills all slots is sieved for nothing, never wrongly.
    """
    out = {}
    for d in _by_pair(masks):
        slot = f"struct({_pair(hashes, d)} & {SLOTS // 64 - 1} as at, {hashes}[i + {d}] & 63 as bit)"
        at = items.where(F.size(hashes) > d).select(F.inline(F.expr(f"transform(sequence(0, size({hashes}) - {d} - 1), i -> {slot})"))).distinct()
        longs = [0] * (SLOTS // 64)
        for r in at.collect():
            longs[r.at] |= 1 << r.bit
        out[d] = f"from_json('[{','.join(str(x - (x >> 63 << 64)) for x in longs)}]', 'array<bigint>')"
    return out


def seeds(df: DataFrame, hashes: str, masks, *keep: str, sieve: dict[int, str] | None = None) -> DataFrame:
    """A row for each mask and word from which it fits: the kept columns, seed and pos (both null in a row without any).

    With a sieve only words count whose pair (a mask's first two words) may stand in an item, so most words are
    looked at once a distance and give no row.
    """

    def one(mask):
        of = f"xxhash64({', '.join([f'{len(mask)}', *map(str, mask), *(f'{hashes}[i + {o}]' for o in mask)])})"
        return f"if(i + {mask[-1]} < size({hashes}), struct({of} as seed, i as pos), null)"

    def group(d, some):
        places = f"sequence(0, size({hashes}) - {d} - 1)"
        held = f"{sieve[d]}[cast({_pair(hashes, d)} & {SLOTS // 64 - 1} as int)]" if sieve else ""
        places = f"filter({places}, i -> (shiftright({held}, cast({hashes}[i + {d}] & 63 as int)) & 1L) = 1L)" if sieve else places
        return f"if(size({hashes}) > {d}, flatten(transform({places}, i -> array({', '.join(map(one, some))}))), array())"

    found = F.expr(f"concat({', '.join(group(d, some) for d, some in _by_pair(masks).items())})")
    # an outer explode, and no filter: one would be pushed down and hash every word again for each seed
    return df.select(*keep, F.explode_outer(found).alias("_s")).select(*keep, "_s.seed", "_s.pos")


def _bounded(df: DataFrame, longs) -> DataFrame:
    """df (cut, as it is counted), marked for broadcast if its rows hold few numbers in all."""
    return F.broadcast(df) if (df.agg(F.sum(longs)).first()[0] or 0) <= BROADCAST_LONGS else df


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_match, n_item for each pair with a seed in common."""
    d = common.texts(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item_id is not null")
    items = common.cut(word_hashes(items, "item", "b").where("size(b) > 0").select("item_id", "b").distinct())
    # one number for each kind of length: fewer than SPAN, then SPAN and LONG for all from there on
    kinds = F.when(F.size("b") < SPAN, F.size("b")).when(F.size("b") < LONG, SPAN).otherwise(LONG)
    classes = {r.n: masks_of(r.n) for r in items.select(kinds.alias("n")).distinct().collect()}
    if not classes:
        return d.where("false").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "n_match", "n_item")])
    index = None
    for n, masks in sorted(classes.items()):
        some = seeds(items.where(kinds == n), "b", masks, "item_id")
        index = some if index is None else index.union(some)
    index = common.cut(index.where("seed is not null").withColumnRenamed("pos", "off").distinct())
    masks = [m for _, some in sorted(classes.items()) for m in some]
    rows = seeds(word_hashes(d, "text", "h"), "h", masks, "doc_id", sieve=sieves(items, "b", masks))
    hits = rows.join(_bounded(index, F.lit(3)), "seed").select("doc_id", "item_id", (F.col("pos") - F.col("off")).alias("diagonal"))
    hits = common.cut(hits.distinct())
    beside = word_hashes(d.join(_bounded(hits, F.lit(3)), "doc_id"), "text", "h").select("doc_id", "item_id", "diagonal", "h").join(_bounded(items, F.size("b") + 1), "item_id")
    # h is named twice, so that the optimizer doesn't move its making into the loop; each diagonal gives maps of 64 places
    # of the item, so that the union over many diagonals is a bounded bit_or
    first, last = "greatest(0, -diagonal)", "least(size(b), size(h) - diagonal) - 1"
    places = f"sequence(greatest({first}, k * 64), least({last}, k * 64 + 63))"
    bits = f"aggregate({places}, 0L, (a, j) -> a | if(h[diagonal + j] = b[j], shiftleft(1L, j - k * 64), 0L))"
    maps = F.expr(f"transform(sequence(cast({first} div 64 as int), cast(({last}) div 64 as int)), k -> struct(k as block, {bits} as bits))")
    # two rows of stretches, shifted by half, so that any two diagonals an item's length apart share one
    stretch = F.explode(F.expr("array(2L * floor(diagonal / (2 * n_item)), 2L * floor((diagonal + n_item) / (2 * n_item)) + 1)"))
    union = (
        beside.select("doc_id", "item_id", "diagonal", F.size("b").alias("n_item"), maps.alias("maps"))
        .select("doc_id", "item_id", "n_item", stretch.alias("stretch"), "maps")
        .select("doc_id", "item_id", "n_item", "stretch", F.inline("maps"))
        .groupBy("doc_id", "item_id", "n_item", "stretch", "block")
        .agg(F.bit_or("bits").alias("bits"))
    )
    totals = union.groupBy("doc_id", "item_id", "n_item", "stretch").agg(F.sum(F.bit_count("bits")).alias("n_match"))
    best = totals.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_match", "n_item"), F.struct(F.col("n_match") / F.col("n_item"), "n_item")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_match").cast("long").alias("n_match"), F.col("m.n_item").cast("long").alias("n_item"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.5) -> DataFrame:
    """doc_id, item_id, n_match, n_item for each item found in a document."""
    return overlaps(docs, benchmark).where(F.col("n_match") >= min_share * F.col("n_item"))


def query(spark, sf_dir):
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
