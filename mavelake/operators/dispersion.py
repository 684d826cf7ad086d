"""Negative-binomial dispersions of variants: a trend over abundance, and each variant's own, shrunk towards it.

Each variant's adjusted profile likelihood is computed on one grid of dispersions, where its row is. Sums of these likelihoods
over bins of abundance are sufficient for the trend: the bins have a fixed width and range, so there are at most BINS rows of
them whatever the number of variants, and no order or quantile of all variants is needed. At each bin, the likelihoods of the
bins around it are averaged, weighted by numbers of variants and a tricube of the distance, over the nearest share of all
variants; their maximum is the trended dispersion there. A variant's own dispersion maximises its likelihood plus the averaged
one at its abundance, weighted by the prior degrees of freedom, which come from the spread of deviances about the trend.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.scratch import cut

#: The dispersions looked at.
GRID = np.exp(np.linspace(np.log(1e-3), np.log(4), 25))
#: Bins of abundance (base-2 logarithm of counts per million): their width, and the range outside of which all counts as its ends.
WIDTH, LOWEST, HIGHEST = 0.1, -10.0, 25.0
BINS = round((HIGHEST - LOWEST) / WIDTH)
#: Variants with fewer counts in all samples together tell nothing about the trend.
LEAST_COUNTS = 5


def nb_fit(y: np.ndarray, offset: np.ndarray, design: np.ndarray, phi: np.ndarray | float, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and means of negative-binomial log-linear fits, all rows at once, by damped Fisher scoring; phi is one
    dispersion or a column of them."""
    off = np.broadcast_to(offset, y.shape)
    start = np.log(np.maximum(y, 0.1)) - off
    beta = start @ np.linalg.pinv(design).T
    eye = 1e-10 * np.eye(design.shape[1])
    for _ in range(steps):
        mu = np.exp(np.clip(beta @ design.T + off, -30, 30))
        w = mu / (1 + phi * mu)
        a = np.einsum("ij,jk,jl->ikl", w, design, design) + eye
        g = ((y - mu) / (1 + phi * mu)) @ design
        step = np.clip(np.linalg.solve(a, g[..., None])[..., 0], -3, 3)
        beta = beta + step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    beta = np.clip(beta, -30, 30)
    return beta, np.exp(np.clip(beta @ design.T + off, -30, 30))


def deviance(y: np.ndarray, mu: np.ndarray, phi: np.ndarray | float) -> np.ndarray:
    mu = np.maximum(mu, 1e-10)
    with np.errstate(all="ignore"):
        a = np.where(y > 0, y * np.log(y / mu), 0.0)
    if np.max(phi, initial=0) < 1e-8:
        return 2 * (a - (y - mu)).sum(1)
    return 2 * (a - (y + 1 / phi) * np.log((1 + phi * y) / (1 + phi * mu))).sum(1)


def abundance(y: np.ndarray, lib: np.ndarray) -> np.ndarray:
    """Base-2 logarithm of counts per million over all samples, with two counts more for a library of mean size."""
    prior = 2 * lib / lib.mean()
    return np.log2((y + prior).sum(1) / (lib + 2 * prior).sum() * 1e6)


def adjusted_likelihood(y: np.ndarray, offset: np.ndarray, design: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """A row per variant: the log likelihood at each dispersion of the grid, less half the log determinant of the information."""
    out = np.empty((len(y), len(grid)))
    for i, phi in enumerate(grid):
        _, mu = nb_fit(y, offset, design, phi)
        like = (special.gammaln(y + 1 / phi) - special.gammaln(1 / phi) - special.gammaln(y + 1) + y * np.log(phi * mu / (1 + phi * mu)) - np.log1p(phi * mu) / phi).sum(1)
        _, det = np.linalg.slogdet(np.einsum("ij,jk,jl->ikl", mu / (1 + phi * mu), design, design) + 1e-10 * np.eye(design.shape[1]))
        out[:, i] = like - det / 2
    return out


def peak(likelihood: np.ndarray, grid: np.ndarray = GRID) -> np.ndarray:
    """The dispersion of greatest likelihood in each row: the vertex of the parabola about the best grid point."""
    step = np.log(grid[1] / grid[0])
    at = np.argmax(likelihood, axis=1)
    inner = np.clip(at, 1, len(grid) - 2)
    rows = np.arange(len(likelihood))
    left, mid, right = (likelihood[rows, inner + d] for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    shift = np.where((at == inner) & (bend < 0), (left - right) / 2 / np.where(bend < 0, bend, -1), at - inner)
    return np.exp(np.log(grid[inner]) + step * np.clip(shift, -1, 1))


def around(x: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Weights of bins (at x, of n variants each) around each bin: tricubes that reach over the nearest share of all variants."""
    far = np.abs(x[:, None] - x[None, :])
    order = np.argsort(far, axis=1, kind="stable")
    enough = np.argmax(np.cumsum(n[order], axis=1) >= share * n.sum() - 1e-9, axis=1)
    reach = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1) + WIDTH / 2
    return n * np.clip(1 - (far / reach) ** 3, 0, None) ** 3


def share_of(n: float) -> float:
    """The share of variants that a trend looks at around a place: all of up to 50, and less the more there are."""
    return 1.0 if n <= 50 else 0.25 + 0.75 * np.sqrt(50 / n)


@dataclass
class Trend:
    """Bins' abundances, trended dispersions and averaged likelihoods (a row per bin)."""

    x: np.ndarray
    dispersion: np.ndarray
    likelihood: np.ndarray

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(x, self.x, np.log(self.dispersion)))

    def likelihood_at(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.interp(x, self.x, column) for column in self.likelihood.T])


def _mapped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield fn(p)

    return df.mapInPandas(run, schema)


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((x - LOWEST) / WIDTH), 0, BINS - 1).astype(np.int32)


def likelihoods(counts: DataFrame, samples: list[str], design: np.ndarray, log_lib: np.ndarray, offset: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(mutantName, x, bin, told, likelihood): abundance, and the likelihood on the grid; told: it has counts enough."""
    lib = np.exp(log_lib)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[samples].to_numpy(float)
        x = abundance(y, lib)
        return pd.DataFrame({"mutantName": pdf["mutantName"], "x": x, "bin": _bin(x), "told": y.sum(1) >= LEAST_COUNTS, "likelihood": list(adjusted_likelihood(y, offset(y), design))})

    return _mapped(counts, run, "mutantName string, x double, bin int, told boolean, likelihood array<double>")


def fit_trend(found: DataFrame) -> Trend:
    sums = [F.sum(F.get("likelihood", F.lit(i))).alias(f"l{i}") for i in range(len(GRID))]
    rows = found.where("told").groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), *sums).orderBy("x").collect()  # BINS at most
    if not rows:
        return Trend(np.zeros(1), GRID[len(GRID) // 2 : len(GRID) // 2 + 1], np.zeros((1, len(GRID))))
    x, n = np.array([r.x for r in rows]), np.array([r.n for r in rows], float)
    total = np.array([[r[f"l{i}"] for i in range(len(GRID))] for r in rows])
    w = around(x, n, share_of(n.sum()))
    averaged = (w / n) @ total / w.sum(1, keepdims=True)
    return Trend(x, peak(averaged), averaged)


@dataclass
class Prior:
    """Prior degrees of freedom, and the variance that goes with them at each abundance."""

    df: float
    x: np.ndarray
    log_mean: np.ndarray

    def variance(self, x: np.ndarray) -> np.ndarray:
        more = 0.0 if np.isinf(self.df) else float(special.digamma(self.df / 2) - np.log(self.df / 2))
        return np.exp(np.interp(x, self.x, self.log_mean) + more)


def squeeze_over(fits: DataFrame, df: float) -> Prior:
    """The prior of residual variances (columns x, s2), whose logarithms follow a trend over x, by the spread about it."""
    e = F.log("s2") - float(special.digamma(df / 2)) + float(np.log(df / 2))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("x") - LOWEST) / WIDTH))).cast("int")
    logs = fits.where("s2 > 1e-15").select("x", e.alias("e"), place.alias("bin"))
    rows = logs.groupBy("bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("e").alias("e")).orderBy("x").collect()  # BINS at most
    if not rows:
        return Prior(float("inf"), np.zeros(1), np.zeros(1))
    x, n, mean = (np.array([r[c] for r in rows], float) for c in ("x", "n", "e"))
    w = around(x, n, share_of(n.sum()))
    mean = w @ mean / w.sum(1)

    def about(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"square": [float(((pdf["e"] - np.interp(pdf["x"], x, mean)) ** 2).sum())]})

    square = _mapped(logs.select("x", "e"), about, "square double").agg(F.sum("square").alias("s")).collect()[0].s or 0.0
    extra = square / max(n.sum() - 1, 1) - float(special.trigamma(df / 2))
    return Prior(2 * special.trigamma_inverse(extra) if extra > 0 else float("inf"), x, mean)


def tagwise(found: DataFrame, trend: Trend, prior_df: float, dof: int) -> DataFrame:
    """(mutantName, dispersion_trend, dispersion_tagwise)."""
    weight = prior_df / max(dof, 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy()
        trended = trend.at(x)
        own = trended if np.isinf(weight) else peak(np.stack(pdf["likelihood"].to_list()) + weight * trend.likelihood_at(x))
        return pd.DataFrame({"mutantName": pdf["mutantName"], "dispersion_trend": trended, "dispersion_tagwise": own})

    return _mapped(found, run, "mutantName string, dispersion_trend double, dispersion_tagwise double")


def estimate(counts: DataFrame, samples: list[str], design: np.ndarray, log_lib: np.ndarray, offset: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[Trend, Prior, DataFrame]:
    """The trend, the prior of deviances about it, and a row per variant with its trended and its own dispersion."""
    offset = offset or (lambda y: log_lib)
    found = cut(likelihoods(counts, samples, design, log_lib, offset))
    trend = fit_trend(found)
    dof, lib = len(design) - design.shape[1], np.exp(log_lib)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[samples].to_numpy(float)
        x = abundance(y, lib)
        phi = trend.at(x)[:, None]
        _, mu = nb_fit(y, offset(y), design, phi)
        return pd.DataFrame({"x": x, "s2": deviance(y, mu, phi) / max(dof, 1)})

    prior = squeeze_over(cut(_mapped(counts, spread, "x double, s2 double")), dof)
    return trend, prior, tagwise(found, trend, prior.df, dof)
