"""Operators over a table of links (de, para, weight, label, source, day)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kind(column: str):
    return F.substring_index(column, ":", 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder that spark.checkpoint.dir names; a local session may do without and gets a temporary one."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Ask for what nobody refers to any more: Spark's cleaner removes the files of shuffles, and of checkpoints where it is told to, only once the driver's heap has been collected, which may be long after."""
    spark._jvm.System.gc()


#: Bytes of Parquet whose rows one task sorts or adds up.
TASK = 8 << 20


def tasks(df: DataFrame) -> int:
    """How many tasks share what df reads: one for every TASK bytes of its files, but no fewer than spark.sql.shuffle.partitions."""
    spark = df.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, df.inputFiles()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))


def spread(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """df dealt by keys to n tasks, if that is more than Spark would take by itself: what a task holds stays the same as inputs grow."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _in_place(df: DataFrame) -> DataFrame:
    """df checkpointed without adaptive execution: an adaptive plan doesn't tell its checkpoint how rows are dealt."""
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def kept_by(df: DataFrame, *keys: str) -> DataFrame:
    """df checkpointed in the partitions and the order of a join on keys: rounds that join it don't shuffle or sort it again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _in_place(df.repartition(n, *keys).sortWithinPartitions(*keys))


#: Rows of a key that are paired with each other in one key.
BLOCK = 256


def block_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """All pairs of rows with node < node among those of one key: by, and every other column twice, as _x and _y.

    Keys of up to BLOCK rows are paired as they are. The rows of a larger one are dealt over blocks of about
    BLOCK, and each two blocks are a key of its own, looked at once, so no task pairs all rows of a frequent
    key. Rows are distinct by (by, node).
    """
    rows = checkpointed(rows)
    rest = [c for c in rows.columns if c not in by]
    large = checkpointed(rows.groupBy(by).agg(F.count("*").alias("_rows")).where(F.col("_rows") > BLOCK).withColumn("_blocks", F.ceil(F.col("_rows") / BLOCK).cast("int")).drop("_rows"))
    side = lambda df, s, *keys: df.select(*by, *keys, *[F.col(c).alias(f"{c}_{s}") for c in rest])
    if not large.limit(1).count():
        return side(rows, "x").join(side(rows, "y"), by).where("node_x < node_y")
    few = rows.join(large, by, "left_anti")
    direct = side(few, "x").join(side(few, "y"), by).where("node_x < node_y")
    dealt = rows.join(large, by).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    x = side(dealt.withColumn("_q", F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1))), "x", F.col("_own").alias("_p"), "_q")
    y = side(dealt.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_own")))), "y", "_p", F.col("_own").alias("_q"))
    met = x.join(y, [*by, "_p", "_q"]).where("_p < _q or node_x < node_y")
    ahead = F.col("node_x") < F.col("node_y")
    turned = [F.when(ahead, F.col(f"{c}_{a}")).otherwise(F.col(f"{c}_{b}")).alias(f"{c}_{a}") for a, b in (("x", "y"), ("y", "x")) for c in rest]
    return direct.select(*by, *[f"{c}_{s}" for s in "xy" for c in rest]).union(met.select(*by, *turned))


#: Nodes of a block of shared_counts(): a group's counts take about SIDE ** 2 * 8 bytes.
SIDE = 2048
#: Keys that are multiplied at once, and rows of a batch that goes back to Spark.
KEYS, OUT = 1024, 1 << 19


def _count_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group of shared_counts(): node_x, node_y, n of all pairs of two blocks' nodes, or of one block's."""
    held, pairs = ([], []), []
    for b in batches:
        side = b.column("side").to_numpy()
        for s in (0, 1):
            some = b.filter(pa.array(side == s))
            held[s].append((np.repeat(some.column("x").to_numpy(), some.column("keys").value_lengths().fill_null(0).to_numpy()), some.column("keys").flatten().to_numpy()))
        some = b.filter(pa.array(side == 2))
        pairs.append(np.stack([some.column(c).to_numpy() for c in ("x", "y", "n")]))
    x, y, n = np.concatenate(pairs, axis=1)
    sides = [[np.concatenate(c) for c in zip(*h)] for h in held]
    own = key[0] == key[1]
    if own:
        sides[1] = sides[0]
        ids = [np.unique(np.concatenate([sides[0][0], x, y]))] * 2
    else:
        ids = [np.unique(np.concatenate([nodes, of])) for (nodes, _), of in zip(sides, (x, y))]
    counts = np.zeros([len(i) for i in ids], dtype=np.int64)
    counts[np.searchsorted(ids[0], x), np.searchsorted(ids[1], y)] += n
    common = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(common), KEYS):
        part, ones = common[at : at + KEYS], []
        for (nodes, keys), i in zip(sides, ids):
            place = np.minimum(np.searchsorted(part, keys), len(part) - 1)
            hit = part[place] == keys
            one = np.zeros((len(i), len(part)), dtype=np.float32)  # counts of at most KEYS are exact
            one[np.searchsorted(i, nodes[hit]), place[hit]] = 1
            ones.append(one)
        counts += (ones[0] @ ones[1].T).astype(np.int64)
    if own:
        counts = np.triu(counts, 1)
    rows = max(1, OUT // max(1, len(ids[1])))
    for at in range(0, len(ids[0]), rows):
        i, j = np.nonzero(counts[at : at + rows])
        a, b = ids[0][at + i], ids[1][j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(counts[at + i, j])], ["node_x", "node_y", "n"])


def shared_counts(rows: DataFrame) -> DataFrame:
    """node_x, node_y, n: for every two nodes with a key in common, node_x < node_y, how many they have. rows: key, node (both long, not null), distinct.

    Keys of up to BLOCK rows are paired by a join. For the others nodes are dealt by hash over blocks of about SIDE,
    and any two blocks are a group: its counts are a product of two matrices of ones, so pairs of a frequent key are
    added up where they are made. What is shuffled is each node's frequent keys, once a block.
    """
    rows = checkpointed(rows.select("key", "node"))
    large = checkpointed(rows.groupBy("key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > BLOCK).select("key"))
    few = rows.join(large, "key", "left_anti")
    pairs = few.select("key", F.col("node").alias("x")).join(few.select("key", F.col("node").alias("y")), "key").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n"))
    if not large.limit(1).count():
        return pairs.toDF("node_x", "node_y", "n")
    blocks = -(-rows.select("node").distinct().count() // SIDE)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    none = F.lit(None).cast("long")
    held = rows.join(large, "key").groupBy("node").agg(F.collect_list("key").alias("keys")).withColumn("own", block("node"))
    met = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side"))))
    held = held.select("node", "keys", met.alias("m")).select("m.p", "m.q", "m.side", F.col("node").alias("x"), none.alias("y"), none.alias("n"), "keys")
    ahead = block("x") <= block("y")
    turned = pairs.select(F.least(block("x"), block("y")).alias("p"), F.greatest(block("x"), block("y")).alias("q"), F.lit(2).alias("side"), F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("y"), "n", F.lit(None).cast("array<bigint>").alias("keys"))
    groups = min(blocks * (blocks + 1) // 2, 8192)  # a task each, as far as that goes: what a group gives is much more than what it reads
    return held.union(turned).repartition(groups, "p", "q").groupBy("p", "q").applyInArrow(_count_block, "node_x long, node_y long, n long")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("de", "para", "weight").union(links.select("para", "de", "weight")).toDF("src", "dst", "weight").where("src <> dst")


def adjacency(links: DataFrame) -> DataFrame:
    """Src, dst, weight in both directions, the strongest link of a pair; loops drop out."""
    return _both_ways(links).groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def near_by(links: DataFrame, key: str) -> DataFrame:
    """adjacency(), kept by key (src or dst): links are dealt once, as pairs of nodes meet where one of them is."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _both_ways(links).repartition(n, key).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return _in_place(pairs.sortWithinPartitions(key))


def degree(links: DataFrame) -> DataFrame:
    """Node, degree over all parallel links."""
    ends = links.select(F.explode(F.array("de", "para")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def counts_by_class(links: DataFrame) -> DataFrame:
    """A5: weight, n."""
    return links.groupBy("weight").agg(F.count("*").alias("n"))


def _pivot(owned: DataFrame) -> DataFrame:
    strongest = owned.groupBy("node", "owner").agg(F.max("weight").alias("weight"))
    totals = strongest.groupBy("node").agg(F.count("*").alias("owners"), F.sum("weight").alias("score")).where("owners >= 2")
    return totals.withColumn("strength", F.col("score") / (F.col("owners") - 1))


def shared_identifiers(links: DataFrame, identifiers=("part", "address"), label: str = "partner") -> DataFrame:
    """G3 (i), G2: identifiers that two owners or more share, two independent parties among them: node, owners, score, strength (unrounded)."""
    from .signals import apart

    owned = links.where(kind("para").isin(*identifiers)).select(F.col("para").alias("node"), F.col("de").alias("owner"), "weight")
    partners = links.where(F.col("label") == label).select(F.col("de").alias("person"), F.col("para").alias("company"))
    return _pivot(owned.join(apart(owned, partners), "node", "left_semi"))


def common_partners(links: DataFrame, label: str = "partner") -> DataFrame:
    """G3 (ii): persons tied to two companies or more by a partner link."""
    return _pivot(links.where(F.col("label") == label).select(F.col("de").alias("node"), F.col("para").alias("owner"), "weight"))


#: Pairs that are added up at once in a task of overlap().
PAIRS = 1 << 21


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each owner of a key but its last: owner, the owners after it (ids) and the lesser weight of both (least), packed. near: the key's (id, weight), sorted."""
    for b in batches:
        lists = b.column("near")
        fields, ends, rows, held = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy()), [], 0
        ids, weights = (fields.field(i).to_numpy().astype(np.int32) for i in (0, 1))
        for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
            for i in range(lo, hi - 1):
                rows.append((int(ids[i]), ids[i + 1 : hi].tobytes(), np.minimum(weights[i], weights[i + 1 : hi]).tobytes()))
                held += hi - 1 - i
            if held > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["owner", "ids", "least"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["owner", "ids", "least"])


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, common, weight), each pair once, sorted."""
    pair, common, weight = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(pair)
    pair = pair[order]
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[begin], np.add.reduceat(common[order], begin), np.add.reduceat(weight[order], begin)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, common, weight of _tails() in the order of owner: owners are added up as they end, and one with very many pairs in between."""
    parts, held = [], 0

    def told(pair, common, weight):
        for at in range(0, len(pair), OUT):
            cut = slice(at, at + OUT)
            yield pa.RecordBatch.from_arrays([pa.array((pair[cut] >> 32).astype(np.int32)), pa.array((pair[cut] & 0xFFFFFFFF).astype(np.int32)), pa.array(common[cut]), pa.array(weight[cut])], ["x", "y", "common", "weight"])

    for b in batches:
        for owner, ids, least in zip(*[b.column(c).to_pylist() for c in ("owner", "ids", "least")]):
            ids = np.frombuffer(ids, np.int32)
            parts.append(((np.int64(owner) << 32) | ids.astype(np.int64), np.ones(len(ids), np.int64), np.frombuffer(least, np.int32).astype(np.int64)))
            held += len(ids)
            if held > PAIRS:
                pair, common, weight = _added(parts)
                last = np.searchsorted(pair, np.int64(owner) << 32)  # this owner may go on
                yield from told(pair[:last], common[:last], weight[:last])
                parts, held = [(pair[last:], common[last:], weight[last:])], 0
    if parts:
        yield from told(*_added(parts))


def overlap(links: DataFrame, owner: str, shared: str, least: int = 2) -> DataFrame:
    """Owner pairs with ``least`` shared neighbours or more: a, b, common, weight, jaccard (unrounded).

    An owner meets the owners after it of every neighbour, packed in a row, and its pairs are added up where they
    come together: what is shuffled is a number and a weight a pair and neighbour, and a task holds about PAIRS of them.
    Neighbours of more than BLOCK owners are paired in blocks.
    """
    from .ordered import ordinals

    near = checkpointed(links.where((kind("de") == owner) & (kind("para") == shared)).groupBy("de", "para").agg(F.max("weight").alias("weight")))
    size = checkpointed(ordinals(near.groupBy("de").agg(F.count("*").alias("size")), ["de"], "id").withColumn("id", F.col("id").cast("int")))
    rows = checkpointed(near.join(size, "de").select("para", F.col("id").alias("node"), "weight"))
    frequent = checkpointed(rows.groupBy("para").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("para"))
    lists = rows.join(frequent, "para", "left_anti").groupBy("para").agg(F.array_sort(F.collect_list(F.struct("node", "weight"))).alias("near")).where("size(near) > 1").select("near")
    tails = lists.mapInArrow(_tails, "owner int, ids binary, least binary")
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = tails.repartition(n, "owner").sortWithinPartitions("owner").mapInArrow(_pair_sums, "x int, y int, common long, weight long")
    if frequent.limit(1).count():
        each = block_pairs(rows.join(frequent, "para", "left_semi"), ["para"])
        pairs = pairs.union(each.groupBy(F.col("node_x").alias("x"), F.col("node_y").alias("y")).agg(F.count("*").alias("common"), F.sum(F.least("weight_x", "weight_y")).alias("weight")))
        pairs = pairs.groupBy("x", "y").agg(F.sum("common").alias("common"), F.sum("weight").alias("weight"))
    of = lambda c: size.select(F.col("id").alias(c), F.col("de").alias(f"{c}_name"), F.col("size").alias(f"{c}_size"))
    both = pairs.where(F.col("common") >= least).join(of("x"), "x").join(of("y"), "y")
    return both.select(F.col("x_name").alias("a"), F.col("y_name").alias("b"), "common", "weight", (F.col("common") / (F.col("x_size") + F.col("y_size") - F.col("common"))).alias("jaccard"))


def dense_identifiers(links: DataFrame, least: int = 4) -> DataFrame:
    """H2: identifiers with ``least`` owners or more."""
    return links.where(kind("para").isin("part", "address")).groupBy(F.col("para").alias("node")).agg(F.countDistinct("de").alias("owners")).where(F.col("owners") >= least)


def without_weak(links: DataFrame) -> DataFrame:
    """Distinct de, para, weight, label; inferred links of a pair with stronger evidence are dropped."""
    pair = (F.least("de", "para"), F.greatest("de", "para"))
    strong = links.where("weight > 1").select(pair[0].alias("_x"), pair[1].alias("_y")).distinct()
    kept = links.where("weight = 1").join(strong, (pair[0] == F.col("_x")) & (pair[1] == F.col("_y")), "left_anti")
    return links.where("weight > 1").union(kept).select("de", "para", "weight", "label").distinct()


def timeline(links: DataFrame) -> DataFrame:
    """A row for each dated piece of evidence."""
    return links.where("day is not null").groupBy("day", "de", "para", "label").agg(F.count("*").alias("n"))


def timing(partners: DataFrame, events: DataFrame, window: int = 180) -> DataFrame:
    """Partner evidence 1 to ``window`` days before an event of the same company: company, d1, d2, days.

    Both sides are distinct days a company, and the join is an equi-join on the company and the window's
    block, so a company with many dates isn't paired with itself in full.
    """
    p = partners.select("company", F.col("day").alias("d1")).distinct()
    e = events.select("company", F.col("day").alias("d2")).distinct().withColumn("block", F.floor(F.unix_date("d2") / window))
    p = p.withColumn("block", F.explode(F.array(F.floor(F.unix_date("d1") / window), F.floor(F.unix_date("d1") / window) + 1)))
    return p.join(e, ["company", "block"]).withColumn("days", F.datediff("d2", "d1").cast("long")).where(F.col("days").between(1, window)).select("company", "d1", "d2", "days")


def conflicting_years(links: DataFrame) -> DataFrame:
    """Links of class 2 or 3 whose evidence falls in two years or more."""
    keys = ["de", "para", "weight", "label"]
    grouped = spread(links.where("weight > 1 and day is not null").select(*keys, "day"), tasks(links), *keys).groupBy(*keys)
    return grouped.agg(F.countDistinct(F.year("day")).alias("years"), F.min(F.year("day")).cast("long").alias("first_year"), F.max(F.year("day")).cast("long").alias("last_year")).where("years >= 2")


def undeclared_holders(links: DataFrame, identifier: str = "part") -> DataFrame:
    """Identifiers with official holders and a declared holder outside that set: node, official, outside."""
    held = links.where((kind("para") == identifier) & (F.col("weight") > 1)).groupBy(F.col("para").alias("node"), "de").agg(F.max("weight").alias("w"))
    totals = held.groupBy("node").agg(F.count_if(F.col("w") == 3).alias("official"), F.count_if(F.col("w") == 2).alias("outside"))
    return totals.where("official > 0 and outside > 0")


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that are never broadcast: its rows don't pass the driver, however few Spark takes them for."""
    return df.hint("shuffle_merge")


def components(edges: DataFrame) -> DataFrame:
    """G2's helper: node, component (smallest node reachable) of an undirected edge list src, dst.

    Every node points to its smallest neighbour or itself, pointers are followed to their ends by jumping, and
    edges are carried over to these ends, each once. So the edges are read in full only in the first
    round; what is left shrinks with every round, and rounds and jumps grow with the logarithm of the size.
    """
    left = checkpointed(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labels = None
    while True:
        ends = left.select("src", "dst").union(left.select("dst", "src")).toDF("node", "near")
        up = checkpointed(ends.groupBy("node").agg(F.least("node", F.min("near")).alias("up")))
        while True:
            above = _shuffled(up.where("node <> up").toDF("up", "top"))
            jumped = checkpointed(up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            up = jumped.select("node", "up")
            freed(edges.sparkSession)
            if not jumped.where("moved").limit(1).count():
                break
        if labels is None:
            labels = up.toDF("node", "component")
        else:
            labels = labels.join(_shuffled(up.toDF("component", "up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        for c in ("src", "dst"):
            left = left.join(_shuffled(up.toDF(c, f"{c}_up")), c)
        left = left.where("src_up <> dst_up").select(F.least("src_up", "dst_up").alias("src"), F.greatest("src_up", "dst_up").alias("dst")).distinct()
        left = checkpointed(left)
        if not left.limit(1).count():
            return labels


def _steps(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.when(F.col("weight") == 3, 2).when(F.col("weight") == 2, 3).otherwise(6).cast("long").alias("step"))


def path_costs(edges: DataFrame, start: str, dealt: bool = False) -> DataFrame:
    """Node, cost, hops of the strongest-evidence path from start; a step costs 2, 3 or 6 by class 3, 2, 1. Nothing for an unknown start.

    Each round relaxes only the nodes that improved in the last one. dealt: edges are kept by src as near_by() does.
    """
    steps = _steps(edges) if dealt else kept_by(_steps(edges), "src")
    best = checkpointed(steps.where(F.col("src") == start).limit(1).select(F.col("src").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("hops")))
    frontier = best
    while True:
        reached = steps.join(_shuffled(frontier), frontier.node == steps.src).select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        new = reached.groupBy("node").agg(F.min(F.struct("cost", "hops")).alias("n"))
        old = best.select("node", F.struct("cost", "hops").alias("o"))
        merged = checkpointed(old.join(new, "node", "full").select("node", F.least("o", "n").alias("b"), (F.col("o").isNull() | (F.col("n") < F.col("o"))).alias("better")))
        best = merged.select("node", "b.cost", "b.hops")
        frontier = merged.where("better").select("node", "b.cost", "b.hops")
        freed(edges.sparkSession)
        if frontier.limit(1).count() == 0:
            return best


def predecessors(edges: DataFrame, costs: DataFrame) -> DataFrame:
    """Node, before: of the neighbours from which a node is reached at its cost and hops the cheapest, then the smallest."""
    far = costs.select(F.col("node").alias("src"), F.col("cost").alias("c"), F.col("hops").alias("h"))
    # a node's least way in is what its cost and hops are; the start has none that is as short
    ways = _steps(edges).join(_shuffled(far), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("c") + F.col("step")).alias("cost"), (F.col("h") + 1).alias("hops"), "c", "src")).alias("m"))
    return ways.join(_shuffled(costs), "node").where("m.cost = cost and m.hops = hops").select("node", F.col("m.src").alias("before"))


def cheapest_path(edges: DataFrame, links: DataFrame, start: str, end: str, costs: DataFrame | None = None) -> DataFrame | None:
    """Hop, de, para, weight, label, source of the cheapest path; each hop by its strongest link, then label. None if there is none; no rows if start is end.

    links: de, para, weight, label and sources, in one row or several. costs: what path_costs() gave for start, where it is known. The way back is followed hop by hop, so what reaches the driver is the path.
    """
    costs = checkpointed(path_costs(edges, start)) if costs is None else costs
    if not costs.where(F.col("node") == end).limit(1).count():
        return None
    before, way = checkpointed(predecessors(edges, costs)), [end]
    while way[-1] != start:
        way.append(before.where(F.col("node") == way[-1]).first().before)
    way.reverse()
    hops = edges.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(way, way[1:]))], "hop int, x string, y string")
    on = (F.least("de", "para") == F.least("x", "y")) & (F.greatest("de", "para") == F.greatest("x", "y"))
    found = links.join(F.broadcast(hops), on).groupBy("hop", "x", "y").agg(F.min(F.struct((-F.col("weight")).alias("w"), "label", "de", F.element_at("sources", 1).isNull().alias("none"), F.element_at("sources", 1).alias("source"))).alias("l"))
    return found.select("hop", F.col("x").alias("de"), F.col("y").alias("para"), (-F.col("l.w")).alias("weight"), "l.label", "l.source").orderBy("hop")


#: Numbers a bucket of islands spans.
SPAN = 1 << 16


def islands(numbers: DataFrame, gap: int = 10) -> DataFrame:
    """Runs of neighbouring numbers in a group (grp, number), at most ``gap`` apart, of two or more: grp, low, high, n.

    Windows run within buckets of SPAN numbers; only each bucket's last number and last beginning of a run go on to the next ones.
    """
    rows = checkpointed(numbers.select("grp", "number").distinct().withColumn("bucket", F.floor(F.col("number") / SPAN)))
    inside = Window.partitionBy("grp", "bucket").orderBy("number")
    along = Window.partitionBy("grp").orderBy("bucket")
    highest = rows.groupBy("grp", "bucket").agg(F.max("number").alias("high")).withColumn("earlier", F.lag("high").over(along)).select("grp", "bucket", "earlier")
    before = F.coalesce(F.lag("number").over(inside), "earlier")
    begun = rows.join(highest, ["grp", "bucket"]).withColumn("begin", F.when(before.isNull() | (F.col("number") - before > gap), F.col("number")))
    begun = checkpointed(begun.withColumn("run", F.last("begin", True).over(inside)))
    carried = begun.groupBy("grp", "bucket").agg(F.max("begin").alias("last")).withColumn("carry", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, -1))).select("grp", "bucket", "carry")
    runs = begun.join(carried, ["grp", "bucket"]).groupBy("grp", F.coalesce("run", "carry").alias("low")).agg(F.max("number").alias("high"), F.count("*").alias("n"))
    return runs.where("n >= 2").select("grp", "low", "high", "n")


def communities(links: DataFrame, sweeps: int = 50) -> DataFrame:
    """Node, community by weighted label propagation; a community is named by its smallest node.

    A node takes the label its neighbours weigh most, its own on a tie, else the
    smallest. In each half sweep only the nodes of one hash parity move, so no two
    neighbours swap labels for ever and every step is one join and two aggregations.
    Isolated nodes have no row.
    """
    near = near_by(links, "dst")
    labels = checkpointed(near.select(F.col("dst").alias("node")).distinct().withColumn("label", F.col("node")))
    still = 0
    for half in range(2 * sweeps):
        moving = F.pmod(F.xxhash64("node"), F.lit(2)) == half % 2
        asked = near.where(F.pmod(F.xxhash64("src"), F.lit(2)) == half % 2)  # only what moves is voted on
        votes = asked.join(_shuffled(labels.toDF("dst", "vote")), "dst").groupBy(F.col("src").alias("node"), "vote").agg(F.sum("weight").alias("w"))
        own = labels.where(moving).join(votes, "node").withColumn("rank", F.struct(-F.col("w"), F.col("vote") != F.col("label"), "vote"))
        new = own.groupBy("node").agg(F.min("rank")["vote"].alias("new"))
        merged = checkpointed(labels.join(new, "node", "left").select("node", F.coalesce("new", "label").alias("label"), F.col("label").alias("was")))
        still = 0 if merged.where("label <> was").limit(1).count() else still + 1
        labels = merged.select("node", "label")
        freed(links.sparkSession)
        if still == 2:
            break
    names = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(names, "label").select("node", "community")


def _chosen(near: DataFrame, labels: DataFrame, active: DataFrame | None) -> DataFrame:
    """node, new: what the active nodes choose (None: all). A smaller neighbour votes with its label of this sweep (now), a larger one with that of the last (was)."""
    vote = F.when(F.col("dst") < F.col("src"), F.col("now")).otherwise(F.col("was"))
    if active is None:
        asked = near.join(_shuffled(labels.withColumnRenamed("node", "dst")), "dst")  # near stays where it is
    else:  # links go both ways: those of active nodes are found where they are, and they alone are dealt to their neighbours
        mine = near.join(_shuffled(active.withColumnRenamed("node", "dst")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        asked = mine.join(_shuffled(labels.withColumnRenamed("node", "dst")), "dst")
    votes = asked.groupBy(F.col("src").alias("node"), vote.alias("vote")).agg(F.sum("weight").alias("w"))
    own = votes.join(labels.select("node", "was"), "node")
    return own.groupBy("node").agg(F.min(F.struct(-F.col("w"), F.col("vote") != F.col("was"), F.col("vote")))["vote"].alias("new"))


def ordered_communities(links: DataFrame, sweeps: int = 50) -> DataFrame:
    """Node, community: weighted label propagation as if one node after another moved, in the order of their names, at any size.

    A node takes the label its neighbours weigh most, its own on a tie, else the smallest. What it takes
    depends on the smaller neighbours' labels of this sweep and the larger ones' of the last, so a sweep is
    the only solution of a triangular system: nodes choose at once, and those with a smaller neighbour whose
    choice changed choose again until none changes. That takes as many joins as a change travels far, not as
    many as there are nodes, and only nodes near a change take part. A sweep begins with the nodes that have
    a larger neighbour that moved in the last one; for any other node nothing has changed.
    A community is named by its smallest node; isolated nodes have no row.
    """
    near = near_by(links, "dst")
    larger, smaller = near.where("src < dst"), near.where("dst < src")
    labels = checkpointed(near.select(F.col("dst").alias("node")).distinct().withColumns({"was": F.col("node"), "now": F.col("node")}))
    active = None
    for _ in range(sweeps):
        while True:
            stepped = labels.join(_chosen(near, labels, active), "node", "left").select("node", "was", F.coalesce("new", "now").alias("now"), (F.coalesce("new", "now") != F.col("now")).alias("moved"))
            stepped = checkpointed(stepped)
            labels = stepped.select("node", "was", "now")
            active = checkpointed(smaller.join(_shuffled(stepped.where("moved").select(F.col("node").alias("dst"))), "dst").select(F.col("src").alias("node")).distinct())
            freed(links.sparkSession)
            if not active.limit(1).count():
                break
        changed = labels.where("now <> was").select(F.col("node").alias("dst"))
        active = checkpointed(larger.join(_shuffled(changed), "dst").select(F.col("src").alias("node")).distinct())
        labels = labels.select("node", F.col("now").alias("was"), "now")
        if not active.limit(1).count():
            break
    names = labels.groupBy("now").agg(F.min("node").alias("community"))
    return labels.join(names, "now").select("node", "community")


def community_names(groups: DataFrame, links: DataFrame, owners=("person", "company", "consortium"), labels: DataFrame | None = None) -> DataFrame:
    """Number (from 1, by size and then by smallest node), community, size, label: the two owners with most neighbours, then smallest.

    groups: node, community. labels (node, label) says how nodes are called, else their names do; what stands in square brackets is left out.
    """
    from .ordered import ordinals

    sizes = groups.groupBy("community").agg(F.count("*").alias("size"))
    numbered = ordinals(sizes, [F.col("size").desc(), "community"], "number").withColumn("number", F.col("number") + 1)
    reach = adjacency(links).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("near"))
    held = groups.where(kind("node").isin(*owners)).join(reach, "node")
    # two rounds of a least row, so that no community's nodes meet in one window
    first = held.groupBy("community").agg(F.min(F.struct(-F.col("near"), F.col("node"))).alias("a"))
    second = held.join(first, "community").where(F.col("node") != F.col("a.node")).groupBy("community").agg(F.min(F.struct(-F.col("near"), F.col("node"))).alias("b"))
    called = labels if labels is not None else groups.select("node", F.col("node").alias("label"))
    short = called.select("node", F.regexp_replace("label", r"\s*\[.*?\]", "").alias("called"))
    top = first.join(second, "community", "left").select("community", F.posexplode(F.array(F.col("a.node"), F.col("b.node"))).alias("place", "node")).join(short, "node")
    told = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "called"))), lambda x: x["called"]), ", ").alias("owners"))
    named = numbered.join(told, "community", "left")
    return named.select("number", "community", "size", F.concat(F.lit("Grupo "), F.col("number").cast("string"), F.lit(" — "), F.coalesce("owners", F.lit("sem donos"))).alias("label"))


#: Most nodes of a block of betweenness(), and numbers (nodes of a block by sources of a slice) a matrix of a task holds.
NODES, CELLS = 1 << 20, 1 << 24
#: Numbers (nodes by sources) of a round of betweenness(): what is on disk at once grows with them.
ROUND = 1 << 27
#: Edges or numbers of a row that carries them packed, and edges that are added up at once.
PIECE, AT_ONCE = 1 << 18, 1 << 14

_LEVEL = "what int, block int, slice int, lo int, form string, bits binary, vals binary"


def _pack_edges(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group of edges between two blocks: rows of up to PIECE edges in the order of dst: bits has each dst and its number of edges, vals has every src."""
    src, dst = np.concatenate([np.stack([b.column(c).to_numpy() for c in ("src", "dst")]) for b in batches], axis=1).astype(np.uint32)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    for at in range(0, len(src), PIECE):
        ends, counts = np.unique(dst[at : at + PIECE], return_counts=True)
        cells = [key[0].as_py(), key[1].as_py(), np.stack([ends, counts.astype(np.uint32)]).tobytes(), src[at : at + PIECE].tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["p", "q", "bits", "vals"])


def _pieces(what: int, block: int, part: int, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The numbers of a matrix that aren't 0, as rows of _LEVEL; whole numbers in as few bytes as they need."""
    step = max(1, PIECE // whole.shape[1])
    for lo in range(0, len(whole), step):
        some = whole[lo : lo + step]
        there = some != 0
        if there.any():
            vals, form = some[there], "f8"
            if (vals == np.floor(vals)).all() and vals.max() < 1 << 32:
                form = next(f for f, top in (("u1", 1 << 8), ("u2", 1 << 16), ("u4", 1 << 32)) if vals.max() < top)
            cells = [what, block, part, lo, form, np.packbits(there).tobytes(), vals.astype(form).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (*[pa.int32()] * 4, pa.string(), pa.binary(), pa.binary()))], ["what", "block", "slice", "lo", "form", "bits", "vals"])


def _unpack(into: np.ndarray, lo: int, form: str, bits: bytes, vals: bytes) -> None:
    some = into[lo : lo + max(1, PIECE // into.shape[1])]
    some[np.unpackbits(np.frombuffer(bits, np.uint8), count=some.size).astype(bool).reshape(some.shape)] = np.frombuffer(vals, form)


def _add_edges(into: np.ndarray, x: np.ndarray, live: np.ndarray, bits: bytes, vals: bytes) -> None:
    """Add every edge's row of x to its row of into."""
    src = np.frombuffer(vals, np.uint32)
    dst, counts = np.frombuffer(bits, np.uint32).reshape(2, -1)
    kept = live[src]
    if not kept.all():  # most rows are empty in the first levels
        every = np.repeat(dst, counts)[kept]
        src, (dst, counts) = src[kept], np.unique(every, return_counts=True)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    for at in range(0, len(src), AT_ONCE):
        some = src[at : at + AT_ONCE].astype(np.intp)
        lo, hi = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(some))
        into[dst[lo:hi]] += np.add.reduceat(x.take(some, axis=0), np.maximum(starts[lo:hi] - at, 0), axis=0)


def _next_level(size: int, width: int, slices: int, back: bool):
    """What one task of a level does: the block of nodes and slice of sources ``task`` names, size by width numbers.

    Rows come in the order of p and turn: own numbers (p = -1), then for each block p what its nodes send and its edges
    to this block. Forward the paths that reach nodes without a number in this level and the one before are the next
    level. Back own numbers are the level's paths: what is sent on is (1 + share) / paths, and each node's shares are
    added up over the slice (what = 1).
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = divmod(key[0].as_py(), slices)
        got, own, x, live, last = np.zeros((size, width)), np.zeros((size, width)), None, None, (-1, 0)
        for b in batches:
            for p, turn, lo, form, bits, vals in zip(*[b.column(c).to_pylist() for c in ("p", "turn", "lo", "form", "bits", "vals")]):
                if (p, turn) < last:
                    raise ValueError("rows of a task are out of order")
                if p != last[0]:
                    x = live = None
                last = (p, turn)
                if turn == 0:
                    _unpack(own, lo, form, bits, vals)
                elif turn == 1:
                    x = np.zeros((size, width)) if x is None else x
                    _unpack(x, lo, form, bits, vals)
                    if p == block and not back:
                        _unpack(own, lo, form, bits, vals)
                elif x is not None:
                    live = x.any(axis=1) if live is None else live
                    _add_edges(got, x, live, bits, vals)
        del x, live
        if not back:
            got[own != 0] = 0
            yield from _pieces(0, block, part, got)
            return
        got *= own  # shares
        yield from _pieces(1, block, part, got.sum(axis=1, keepdims=True))
        there = own != 0
        got[there] = (1 + got[there]) / own[there]
        yield from _pieces(0, block, part, got)

    return run


def betweenness(links: DataFrame, most: int | None = None, exact: int = 800, isolated: DataFrame | None = None) -> DataFrame:
    """Node, betweenness (unweighted, normalised by (n-1)(n-2)) of the nodes that have links, and of those of ``isolated`` (node).

    Exact: every node is a source. With ``most``, the reference's way beyond ``exact`` nodes: about so many sources, picked by hash, and scaled up.
    Sources go in rounds of ROUND numbers. Those of a round advance
    together, forward to count shortest paths and backward to share them out. Nodes are dealt over blocks and sources over
    slices; a level's task has a block and a slice, and adds up what each block's nodes send along their edges to it. What a
    task holds are a few matrices of CELLS numbers, and a number of a node and source is sent once to each block,
    not once an edge. What stays on disk are the levels of one round. All in all it takes nodes times links.
    """
    from .ordered import ordinals

    spark = links.sparkSession
    near = checkpointed(adjacency(links).select("src", "dst"))
    nodes = near.select(F.col("src").alias("node"))
    nodes = checkpointed((nodes.union(isolated.select("node")) if isolated is not None else nodes).distinct())
    n = nodes.count()
    if n <= 2:
        return nodes.withColumn("betweenness", F.lit(0.0))
    numbered = checkpointed(ordinals(nodes, [F.xxhash64("node"), "node"], "place"))
    starts = numbered if most is None or n <= exact else numbered.where(F.pmod(F.xxhash64("node"), F.lit(-(-n // most))) == 0)
    starts = checkpointed(ordinals(starts, ["place"], "source").select("place", "source"))
    found = starts.count()
    picked = max(1, found)
    blocks = -(-n // NODES)
    size = -(-n // blocks)
    rounds = min(picked, -(-picked * n // ROUND))
    batch = -(-picked // rounds)
    slices = min(batch, max(-(-batch * size // CELLS), -(-spark.sparkContext.defaultParallelism // blocks)))
    width = -(-batch // slices)
    tasks = blocks * slices

    at = lambda c: F.floor(F.col(c) / size).cast("int")
    within = lambda c: (F.col(c) % size).cast("int")
    ends = near.where("src < dst")
    for c in ("src", "dst"):
        ends = ends.join(_shuffled(numbered.select(F.col("node").alias(c), F.col("place").alias(f"{c}_at"))), c)
    ends = ends.select(F.explode(F.array(F.struct(F.col("src_at").alias("a"), F.col("dst_at").alias("b")), F.struct(F.col("dst_at").alias("a"), F.col("src_at").alias("b")))).alias("e")).select("e.a", "e.b")
    cuts = -(-near.count() // (blocks * blocks * 4 * PIECE)) or 1
    dealt = ends.select(at("a").alias("p"), at("b").alias("q"), F.pmod(F.xxhash64("b"), F.lit(cuts)).alias("cut"), within("a").alias("src"), within("b").alias("dst"))
    edges = checkpointed(dealt.groupBy("p", "q", "cut").applyInArrow(_pack_edges, "p int, q int, bits binary, vals binary"))

    all_slices, all_blocks = F.sequence(F.lit(0), F.lit(slices - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    along = edges.select(F.explode(F.transform(all_slices, lambda i: F.col("q") * slices + i)).alias("task"), "p", F.lit(2).alias("turn"), F.lit(0).alias("lo"), F.lit("").alias("form"), "bits", "vals")

    def advance(sent: DataFrame, own: DataFrame | None, back: bool = False) -> DataFrame:
        sent = sent.where("what = 0")
        rows = along.join(F.broadcast(sent.select("slice").distinct()), F.col("task") % slices == F.col("slice"), "left_semi")
        rows = rows.union(sent.select(F.explode(F.transform(all_blocks, lambda i: i * slices + F.col("slice"))).alias("task"), F.col("block").alias("p"), F.lit(1).alias("turn"), "lo", "form", "bits", "vals"))
        if own is not None:
            rows = rows.union(own.select((F.col("block") * slices + F.col("slice")).alias("task"), F.lit(-1).alias("p"), F.lit(0).alias("turn"), "lo", "form", "bits", "vals"))
        rows = rows.repartitionById(tasks, "task").sortWithinPartitions("task", "p", "turn")
        return checkpointed(rows.groupBy("task").applyInArrow(_next_level(size, width, slices, back), _LEVEL))

    def begin(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros((size, width))
        for b in batches:
            first[b.column("node").to_numpy(), b.column("of").to_numpy()] = 1
        yield from _pieces(0, key[0].as_py(), key[1].as_py(), first)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lo, form, bits, vals in zip(*[c.to_pylist() for c in b.columns]):
                some = np.zeros((size - lo if size - lo < PIECE else PIECE, 1))
                some[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(some)).astype(bool), 0] = np.frombuffer(vals, form)
                place = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(place + (block * size + lo)), pa.array(some[place, 0])], ["place", "share"])

    def shared(some: DataFrame) -> list[DataFrame]:
        """The shares of a round's sources, a table for each level."""
        of = some.select(at("place").alias("block"), F.floor(F.col("source") / width).cast("int").alias("slice"), within("place").alias("node"), (F.col("source") % width).cast("int").alias("of"))
        levels, parts = [checkpointed(of.groupBy("block", "slice").applyInArrow(begin, _LEVEL))], []
        while True:
            new = advance(levels[-1], levels[-2] if len(levels) > 1 else None)
            freed(spark)
            if not new.limit(1).count():
                break
            levels.append(new)
        # nodes of the deepest level send on 1 / paths, as their shares are 0; each level does so over its shortest paths
        shares = levels[-1].where("false")
        while len(levels) > 1:
            shares = advance(shares, levels.pop(), True)
            parts.append(checkpointed(shares.where("what = 1").select("block", "lo", "form", "bits", "vals")))  # the level itself may go
            freed(spark)
        return parts

    sums = None
    for i in range(rounds):
        parts = shared(starts.where(F.floor(F.col("source") / batch) == i).withColumn("source", F.col("source") % batch))
        for part in parts:
            shares = part.mapInArrow(told, "place long, share double")
            sums = shares if sums is None else sums.union(shares)
        if sums is not None:
            sums = checkpointed(sums.groupBy("place").agg(F.sum("share").alias("share")))
    if sums is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    scale = n / picked / ((n - 1) * (n - 2))
    sums = sums.select("place", (F.col("share") * scale).alias("b"))
    return numbered.join(_shuffled(sums), "place", "left").select("node", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def bridges(central: DataFrame, groups: DataFrame, links: DataFrame, top: int = 5) -> DataFrame:
    """H3: of the ``top`` nodes by positive betweenness those whose neighbours span two communities or more."""
    best = checkpointed(central.where("betweenness > 0").orderBy(F.desc("betweenness"), "node").limit(top))
    ends = links.select(F.explode(F.array(F.struct(F.col("de").alias("node"), F.col("para").alias("near")), F.struct(F.col("para").alias("node"), F.col("de").alias("near")))).alias("e")).select("e.node", "e.near")
    near = ends.where("node <> near").join(F.broadcast(best.select("node")), "node", "left_semi").distinct()  # only what the few best are tied to
    spans = near.join(groups.toDF("near", "community"), "near").groupBy("node").agg(F.countDistinct("community").alias("communities"))
    return best.join(spans, "node").where("communities >= 2")
