"""Call records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_pairs(calls: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """A1 over event time: start, a, b, n, seconds of each directed pair and window; calls later than ``late`` are dropped.

    calls: a, b, ts (timestamp), value, streaming or not. State is bounded by the watermark.
    """
    known = calls.where("a <> b").withWatermark("ts", late)
    totals = known.groupBy(F.window("ts", window).alias("w"), "a", "b").agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("seconds"))
    return totals.select(F.col("w.start").alias("start"), "a", "b", "n", "seconds")
