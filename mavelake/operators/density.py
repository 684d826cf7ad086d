"""Kernel densities in one and two dimensions from counts on a grid.

Rows are counted at their nearest grid point, by one aggregation that Spark combines before it shuffles. A Gaussian kernel is
then put on the counts: in two dimensions as one matrix product along each axis. A group that a task sees is a grid (of one
sample, or of one pair of samples), whatever the number of rows. Widths follow the usual rule of thumb from the standard
deviation and the quartiles, which are exact order statistics.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .selection import quantiles

#: The rule's factors for one and two dimensions, and the normal distribution's interquartile range.
ONE, TWO, IQR = 0.9, 1.06, 1.34


def axes(values: DataFrame, factor: float, common: bool = False) -> DataFrame:
    """(sample, lo, hi, h): range (or that of all samples) and kernel width of each sample from (sample, x); x is neither null
    nor NaN."""
    spark = values.sparkSession
    flat = values.select(F.col("sample").alias("c"), F.col("x").alias("v"))
    rows = flat.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).collect()  # a row per sample
    low, high = quantiles(flat, 0.25), quantiles(flat, 0.75)
    out = []
    for r in rows:
        sd = r.sd or 0.0
        out.append((r.c, float(r.lo), float(r.hi), factor * float(min(sd, (high[r.c] - low[r.c]) / IQR) or sd or 1.0) * r.n**-0.2))
    if common and out:
        lo, hi = min(r[1] for r in out), max(r[2] for r in out)
        out = [(c, lo, hi, h) for c, _, _, h in out]
    return spark.createDataFrame(out, "sample string, lo double, hi double, h double")


def place(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """The nearest of n grid points from lo to hi; all are at the first if there is no range."""
    return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * (n - 1) + 0.5)).otherwise(0).cast("int")


def grid(lo: float, hi: float, n: int) -> np.ndarray:
    return lo + np.arange(n) * ((hi - lo) or 1.0) / (n - 1)


def kernel(points: np.ndarray, h: float) -> np.ndarray:
    return np.exp(-0.5 * ((points[:, None] - points) / h) ** 2) / (h * np.sqrt(2 * np.pi))


def density(values: DataFrame, n: int = 512) -> DataFrame:
    """(sample, x, density) at n grid points over the range of all samples, from (sample, x)."""
    values = cut(values.where(F.col("x").isNotNull() & ~F.isnan("x")).select("sample", F.col("x").cast("double").alias("x")))
    ends = F.broadcast(axes(values, ONE, common=True))
    counts = values.join(ends, "sample").groupBy("sample", "lo", "hi", "h", place(F.col("x"), F.col("lo"), F.col("hi"), n).alias("i")).agg(F.count("*").alias("n"))

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        points, at = grid(first.lo, first.hi, n), np.zeros(n)
        at[part["i"]] = part["n"]
        return pd.DataFrame({"sample": first["sample"], "x": points, "density": kernel(points, first.h) @ at / at.sum()})

    return counts.groupBy("sample").applyInPandas(smooth, "sample string, x double, density double")


def pair_counts(wide: DataFrame, samples: list[str], n: int) -> DataFrame:
    """(sample1, sample2, i, j, n): rows by their nearest grid points, for all pairs of samples, with the range and width of both
    (lo1, hi1, h1, lo2, hi2, h2). A row counts for a pair if it has both values."""
    ends = axes(_long(wide, samples), TWO)
    pairs = [F.struct(F.lit(a).alias("sample1"), F.lit(b).alias("sample2"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in combinations(samples, 2)]
    rows = wide.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    for k in "12":
        rows = rows.join(F.broadcast(ends.toDF(f"sample{k}", f"lo{k}", f"hi{k}", f"h{k}")), f"sample{k}")
    at = [place(F.col(v), F.col(f"lo{k}"), F.col(f"hi{k}"), n).alias(c) for v, k, c in (("x", 1, "i"), ("y", 2, "j"))]
    return rows.groupBy("sample1", "sample2", *(f"{c}{k}" for k in "12" for c in ("lo", "hi", "h")), *at).agg(F.count("*").alias("n"))


def _long(wide: DataFrame, samples: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").cast("double").alias("x")) for s in samples))
    long = wide.select(F.explode(cells).alias("v")).select("v.*")
    return cut(long.where(F.col("x").isNotNull() & ~F.isnan("x")))


def pair_density(wide: DataFrame, samples: list[str], n: int = 200) -> DataFrame:
    """(sample1, sample2, x, y, density) on n by n grid points for all pairs of samples (columns of wide).

    Null and NaN values take no part; a pair without a row that has both values has no rows. A sample whose values are all equal
    has a width of 1 times the rule's factor."""
    if n < 2:
        raise ValueError("a grid has at least 2 points a side")
    if len(samples) < 2:
        return wide.sparkSession.createDataFrame([], "sample1 string, sample2 string, x double, y double, density double")

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        x, y = grid(first.lo1, first.hi1, n), grid(first.lo2, first.hi2, n)
        at = np.zeros((n, n))
        at[part["i"], part["j"]] = part["n"]
        found = kernel(x, first.h1) @ at @ kernel(y, first.h2).T / at.sum()
        return pd.DataFrame({"sample1": first.sample1, "sample2": first.sample2, "x": np.repeat(x, n), "y": np.tile(y, n), "density": found.ravel()})

    schema = "sample1 string, sample2 string, x double, y double, density double"
    return pair_counts(wide, samples, n).groupBy("sample1", "sample2").applyInPandas(smooth, schema)
