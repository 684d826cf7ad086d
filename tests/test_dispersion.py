"""Dispersions: the grid likelihood against term-by-term sums, and simulated counts of a known trend."""

import math

import numpy as np
import pytest

from mavelake.operators import dispersion as D

SAMPLES = ["a", "b", "c", "d", "e", "f"]
DESIGN = np.column_stack([np.ones(6), [0, 0, 0, 1, 1, 1]])


def simulated(rng, n, phi_of, spread=0.0):
    """Counts of n variants with means over four decades, and their true dispersions."""
    mean = 10 ** rng.uniform(0.7, 4.2, n)
    phi = phi_of(mean) * np.exp(spread * rng.standard_normal(n))
    mu = mean[:, None] * np.exp(0.3 * rng.standard_normal((n, 1)) * DESIGN[:, 1])
    return rng.negative_binomial(1 / phi[:, None], 1 / (1 + phi[:, None] * mu)), phi, mean


def frame(spark, y):
    return spark.createDataFrame([(f"v{i}", *map(float, row)) for i, row in enumerate(y)], ["mutantName", *SAMPLES])


def plain_likelihood(y, mu, phi):
    """Log likelihood of one variant's counts, term by term, and half the log determinant of its information."""
    like = sum(math.lgamma(k + 1 / phi) - math.lgamma(1 / phi) - math.lgamma(k + 1) + k * math.log(phi * m / (1 + phi * m)) - math.log(1 + phi * m) / phi for k, m in zip(y, mu, strict=True))
    info = sum(m / (1 + phi * m) * np.outer(x, x) for m, x in zip(mu, DESIGN, strict=True))
    return like - math.log(np.linalg.det(info)) / 2


def test_grid_likelihood():
    """In each of two groups of equal libraries the fitted mean is the group's mean."""
    rng = np.random.default_rng(1)
    y, _, _ = simulated(rng, 40, lambda m: 0.05 + 0 * m)
    got = D.adjusted_likelihood(y.astype(float), np.zeros(6), DESIGN)
    for i, row in enumerate(y):
        mu = np.repeat([row[:3].mean(), row[3:].mean()], 3)
        if mu.min() > 0:
            for j in (0, 7, 15, 24):
                assert got[i, j] == pytest.approx(plain_likelihood(row, mu, D.GRID[j]), abs=1e-6)


def test_peak():
    at = np.array([0.02, 0.3, 1e-9, 50.0])
    curve = -((np.log(D.GRID)[None, :] - np.log(at)[:, None]) ** 2)
    assert D.peak(curve) == pytest.approx([0.02, 0.3, D.GRID[0], D.GRID[-1]])


def test_known_trend(spark):
    """Counts whose dispersion falls from about 0.5 to 0.03 with their mean."""
    y, phi, mean = simulated(np.random.default_rng(2), 1500, lambda m: 0.02 + 3 / m)
    lib = np.log(y.sum(0).astype(float))
    trend, prior, own = D.estimate(frame(spark, y), SAMPLES, DESIGN, lib)
    x = D.abundance(y.astype(float), np.exp(lib))
    some = (y.sum(1) >= 60) & (mean > 10)
    ratio = np.log(trend.at(x)[some] / phi[some])
    assert abs(ratio.mean()) < 0.1 and ratio.std() < 0.3
    rows = {r.mutantName: r for r in own.collect()}
    assert len(rows) == len(y)
    assert prior.df > 20  # no spread about the trend but that of the counts
    tag = np.log(np.array([rows[f"v{i}"].dispersion_tagwise for i in range(len(y))])[some] / phi[some])
    assert tag.std() < 0.6


def test_own_dispersions(spark):
    """Where variants spread widely about the trend, the prior is weak and their own dispersions follow the true ones."""
    y, phi, mean = simulated(np.random.default_rng(3), 1200, lambda m: 0.15 + 0 * m, spread=1.0)
    _, prior, own = D.estimate(frame(spark, y), SAMPLES, DESIGN, np.log(y.sum(0).astype(float)))
    rows = {r.mutantName: r for r in own.collect()}
    some = np.flatnonzero(mean > 50)
    tag, trended = (np.log([rows[f"v{i}"][c] for i in some]) for c in ("dispersion_tagwise", "dispersion_trend"))
    assert prior.df < 15
    assert np.corrcoef(tag, np.log(phi[some]))[0, 1] > 0.5
    assert ((tag - np.log(phi[some])) ** 2).mean() < ((trended - np.log(phi[some])) ** 2).mean()


def test_bins_are_bounded():
    x = np.array([-1e9, -10.0, 0.0, 24.99, 1e9])
    assert D._bin(x).tolist() == [0, 0, 100, D.BINS - 1, D.BINS - 1]
    w = D.around(np.array([0.0, 1.0, 5.0]), np.array([10.0, 10.0, 10.0]), 0.5)
    assert (w > 0).tolist() == [[True, True, False], [True, True, False], [False, True, True]]


def test_few_and_empty_rows(spark):
    y = np.array([[0, 0, 0, 0, 0, 0], [3, 2, 0, 5, 4, 9]])
    _, _, own = D.estimate(frame(spark, y), SAMPLES, DESIGN, np.log(np.full(6, 1000.0)))
    assert own.count() == 2
    trend, prior, own = D.estimate(frame(spark, y).where("false"), SAMPLES, DESIGN, np.log(np.full(6, 1000.0)))
    assert own.count() == 0 and prior.df == math.inf and len(trend.x) == 1
