"""Exact order statistics of many columns at once, without sorting and without a task that sees a whole column.

In rounds: the values of each request's range are counted in bins, and the bin that holds the wanted rank is the next range,
from its least to its greatest value. A round is one aggregation, which Spark combines before it shuffles, and brings a bounded
number of rows to the driver; each divides a range by BINS, so a few rounds leave one value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256


def order_statistics(values: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values of the given ranks (from 0) in each group; `values` has c (the group) and v (neither null nor NaN)."""
    spark = values.sparkSession
    rows = values.where(F.col("c").isin(list(ranks))).groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
    open_ = {(r.c, k): (r.low, r.high, 0) for r in rows for k in ranks[r.c]}  # range, and how many values are below it
    done: dict[tuple[str, int], float] = {}
    while True:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                done[key] = low
                del open_[key]
        if not open_:
            return done
        asked = spark.createDataFrame([(c, k, float(low), float(high)) for (c, k), (low, high, _) in open_.items()], "c string, k long, low double, high double")
        inside = values.join(F.broadcast(asked), "c").where(F.col("v").between(F.col("low"), F.col("high")))  # a row per request
        at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        found: dict[tuple[str, int], list] = {}
        for r in inside.groupBy("c", "k", at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            found.setdefault((r.c, r.k), []).append((r.bin, r.n, r.low, r.high))
        for key, bins in found.items():
            below = open_[key][2]
            for _, n, low, high in sorted(bins):
                if below + n > key[1]:
                    open_[key] = (low, high, below)
                    break
                below += n


def quantiles(values: DataFrame, p: float) -> dict[str, float]:
    """The quantile of each group of `values` (c, v), between the two values next to it in proportion."""
    sizes = {r.c: r.n for r in values.groupBy("c").agg(F.count("*").alias("n")).collect()}
    places = {c: (n - 1) * p for c, n in sizes.items()}
    found = order_statistics(values, {c: sorted({math.floor(x), math.ceil(x)}) for c, x in places.items()})
    return {c: found[c, math.floor(x)] + (x - math.floor(x)) * (found[c, math.ceil(x)] - found[c, math.floor(x)]) for c, x in places.items()}
