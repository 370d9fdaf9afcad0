import random
from collections import defaultdict

from pyspark.sql import functions as F

from knotwork.operators.ordered import ordinals, running


def test_running_totals_equal_plain_ones(spark):
    r = random.Random(11)
    # one group holds two thirds of all rows, one is null; order has nulls and the last column makes it unique
    rows = [(r.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), r.choice([None, *range(50)]), i, r.randint(-9, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long")
    got = running(df, ["g"], ["o", F.col("i").desc()], add={"n": F.lit(1), "s": F.col("v")}, xor={"x": F.col("v")})
    assert got.columns == ["g", "o", "i", "v", "n", "s", "x"]
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    want = {}
    for of in groups.values():
        total = mixed = 0
        for n, row in enumerate(sorted(of, key=lambda t: (t[1] is not None, t[1] or 0, -t[2])), 1):
            total, mixed = total + row[3], mixed ^ row[3]
            want[row[2]] = (n, total, mixed)
    assert {t.i: (t.n, t.s, t.x) for t in got.collect()} == want


def test_ordinals_of_a_table_equal_a_sorted_list(spark):
    r = random.Random(12)
    words = ["".join(r.choices("abç", k=r.randint(0, 6))) for _ in range(500)] + ["same"] * 900
    got = ordinals(spark.createDataFrame([(w,) for w in words], "w string"), ["w"]).collect()
    assert sorted(t.ordinal for t in got) == list(range(len(words)))
    assert [t.w for t in sorted(got, key=lambda t: t.ordinal)] == sorted(words, key=str.encode)
    assert ordinals(spark.createDataFrame([], "w string"), ["w"]).count() == 0


def test_equal_rows_are_dealt_over_all_ranges(spark):
    df = spark.createDataFrame([(None, "x")] * 4000, "g string, o string").repartition(6)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        out = running(df, ["g"], ["o"], add={"n": F.lit(1)})
        assert sorted(t.n for t in out.collect()) == list(range(1, 4001))
        assert max(t["count"] for t in out.groupBy(F.spark_partition_id()).count().collect()) < 2000
    finally:
        spark.conf.unset(key)
