"""Local weighted regression of many rows on one variable, from sums that Spark adds up.

Lines are fitted at anchors only: the least and the greatest value in each of ANCHORS equal ranges, between which the fit is
interpolated. An anchor's line weighs the nearest share of all rows by the cube of the cubed distance, and rows by how far they
were from the last fit (bisquare at six median residuals). All that depends on the rows is exact:

* the reach of an anchor is the distance of its k-th nearest row. Counts in BINS ranges of x leave few rows in doubt for each
  anchor, and order statistics among these decide;
* a line needs five weighted sums, which each task adds up over its rows for all anchors at once;
* the median residual is an order statistic.

The driver holds 2 * ANCHORS lines and BINS counts, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .selection import order_statistics, quantiles

ANCHORS, BINS = 100, 4096
#: Residuals above six medians count nothing; medians of no more than this share of the mean end the rounds.
CUTOFF, FLAT = 6.0, 1e-7


@dataclass(frozen=True)
class Trend:
    """Fitted values `y` (a column per response) at the anchors `x`, in order."""

    x: np.ndarray
    y: np.ndarray

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.interp(x, self.x, y) for y in self.y.T])


def anchors(rows: DataFrame, n: int = ANCHORS) -> np.ndarray:
    """The least and greatest x in each of n equal ranges of x, without repeats."""
    row = rows.agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()[0]
    if row.low is None:
        return np.array([])
    ends = rows.groupBy(_bin(row.low, row.high, n).alias("b")).agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    return np.unique([v for r in ends for v in (r.low, r.high)])


def _bin(low: float, high: float, n: int):
    return F.least(F.floor((F.col("x") - low) / ((high - low) or 1.0) * n), F.lit(n - 1))


def reaches(rows: DataFrame, at: np.ndarray, k: int) -> np.ndarray:
    """The distance from each anchor to the k-th nearest row (one at its place included)."""
    low, high = float(at[0]), float(at[-1])
    place = _bin(low, high, BINS).alias("b")
    counts = rows.groupBy(place).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    b = np.array([r.b for r in counts])
    n, left, right = (np.array([r[c] for r in counts], float) for c in ("n", "low", "high"))
    out = np.zeros(len(at))
    doubt, ranks = [], {}
    for i, a in enumerate(at):
        near = np.where(a < left, left - a, np.where(a > right, a - right, 0.0))
        far = np.maximum(np.abs(left - a), np.abs(right - a))
        by_near, by_far = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        least = near[by_near[np.searchsorted(np.cumsum(n[by_near]), k)]]  # no fewer than k rows may be that near
        most = far[by_far[np.searchsorted(np.cumsum(n[by_far]), k)]]  # k rows are that near for certain
        if least == most:
            out[i] = least
            continue
        below, some = far < least, (far >= least) & (near <= most)
        doubt += [(int(x), str(i), float(a)) for x in b[some]]
        ranks[str(i)] = [int(k - 1 - n[below].sum())]
    if ranks:
        asked = rows.sparkSession.createDataFrame(doubt, "b long, c string, a double")  # a few ranges for each anchor
        values = cut(rows.select("x", place).join(F.broadcast(asked), "b").select("c", F.abs(F.col("x") - F.col("a")).alias("v")))
        for (i, _), v in order_statistics(values, ranks).items():
            out[int(i)] = v
    return out


def _tricube(x: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Weights, a row per value of x and a column per anchor; where the reach is nothing, rows at the anchor weigh 1."""
    dist = np.abs(x[:, None] - at)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(reach > 0, dist / reach, np.where(dist > 0, 1.0, 0.0))
    return np.clip(1 - share**3, 0, None) ** 3


def _bisquare(y: np.ndarray, fit: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isinf(cuts), 1.0, np.clip(1 - ((y - fit) / cuts) ** 2, 0, None) ** 2)


def _lines(sums: np.ndarray, spread: float) -> np.ndarray:
    """The lines' values at their anchors, from sums of w, wx, wxx, wy, wxy with x relative to the anchor."""
    w, wx, wxx, wy, wxy = (np.where(sums[0] > 0, s / np.where(sums[0] > 0, sums[0], 1), np.nan) for s in sums)
    var = wxx - wx**2
    flat = var <= (1e-3 * spread) ** 2  # all rows at one place: their mean
    slope = np.where(flat, 0.0, (wxy - wx * wy) / np.where(flat, 1.0, var))
    return wy - slope * wx


def local_trend(rows: DataFrame, responses: list[str], span: float = 0.3, rounds: int = 3, n_anchors: int = ANCHORS) -> Trend:
    """The trend of each response over column x, from the nearest `span` of the rows, refitted `rounds` times without outliers.

    Rows in which x or a response is null or NaN take no part; without rows the trend is empty. At an anchor whose rows all count
    nothing as outliers, the line of the round before stays."""
    whole = F.lit(True)
    for c in ("x", *responses):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = cut(rows.where(whole).select(*(F.col(c).cast("double").alias(c) for c in ("x", *responses))))
    n = rows.count()
    at = anchors(rows, n_anchors)
    if not n:
        return Trend(at, np.zeros((0, len(responses))))
    reach = reaches(rows, at, int(np.clip(np.floor(span * n + 1e-7), 2, n))) if n > 1 else np.zeros(1)
    m, spread = len(responses), float(at[-1] - at[0])
    trend, cuts = Trend(at, np.zeros((len(at), m))), np.full(m, np.inf)
    for turn in range(rounds + 1):
        sums = _sums(rows, responses, reach, trend, cuts)
        fit = _lines(sums, spread)
        trend = Trend(at, np.where(np.isnan(fit), trend.y, fit))
        if turn == rounds:
            break
        away = cut(_residuals(rows, responses, trend))
        means = {r.c: r.m for r in away.groupBy("c").agg(F.avg("v").alias("m")).collect()}
        medians = quantiles(away, 0.5)
        cuts = np.array([CUTOFF * medians[c] if CUTOFF * medians[c] > FLAT * means[c] else np.inf for c in responses])
        if np.isinf(cuts).all():
            break
    return trend


def _sums(rows: DataFrame, responses: list[str], reach: np.ndarray, trend: Trend, cuts: np.ndarray) -> np.ndarray:
    """The five weighted sums by response and anchor: (5, anchors, responses)."""
    at, m = trend.x, len(responses)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, len(at), m))
        for whole in frames:
            for start in range(0, len(whole), 4096):
                frame = whole.iloc[start : start + 4096]
                x, y = frame["x"].to_numpy(), frame[responses].to_numpy(float)
                w, robust = _tricube(x, at, reach), _bisquare(y, trend.at(x), cuts)
                # x relative to the middle keeps sums of squares exact; the move to each anchor is made after
                z = x - at[len(at) // 2]
                for i, left in enumerate((np.ones_like(z), z, z * z)):
                    total[i] += (w * left[:, None]).T @ robust
                for i, left in enumerate((np.ones_like(z), z)):
                    total[3 + i] += (w * left[:, None]).T @ (robust * y)
        yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    cells = rows.mapInPandas(add, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # 5 sums a line
    total = np.zeros(5 * len(at) * m)
    for r in cells:
        total[r.cell] = r.v
    w, wx, wxx, wy, wxy = total.reshape(5, len(at), m)
    a = (at - at[len(at) // 2])[:, None]
    return np.array([w, wx - a * w, wxx - 2 * a * wx + a * a * w, wy, wxy - a * wy])


def _residuals(rows: DataFrame, responses: list[str], trend: Trend) -> DataFrame:
    """(c, v): the distance of each response from the trend."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            away = np.abs(frame[responses].to_numpy(float) - trend.at(frame["x"].to_numpy()))
            yield pd.DataFrame({"c": np.tile(responses, len(frame)), "v": away.ravel()})

    return rows.mapInPandas(run, "c string, v double")
