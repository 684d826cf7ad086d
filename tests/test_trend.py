"""Local regression from sums against the plain version that sorts all rows."""

import numpy as np
import pytest

from mavelake.operators import stats, trend


def plain(x, y, span=0.3, rounds=3, n_anchors=100):
    """(anchors, fit) with every row looked at for every anchor."""
    lo, hi = x.min(), x.max()
    b = np.minimum(np.floor((x - lo) / ((hi - lo) or 1) * n_anchors), n_anchors - 1)
    at = np.unique([f(x[b == i]) for i in np.unique(b) for f in (np.min, np.max)])
    k = int(np.clip(np.floor(span * len(x) + 1e-7), 2, len(x))) if len(x) > 1 else 1
    fit, robust = np.zeros(len(at)), np.ones(len(x))
    for _ in range(rounds + 1):
        for i, a in enumerate(at):
            d = np.abs(x - a)
            h = np.sort(d)[k - 1]
            w = (np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else (d == 0) * 1.0) * robust
            if w.sum() <= 0:
                continue
            mx, my = np.average(x - a, weights=w), np.average(y, weights=w)
            var = np.average((x - a - mx) ** 2, weights=w)
            slope = np.average((x - a - mx) * (y - my), weights=w) / var if var > (1e-3 * (hi - lo)) ** 2 else 0
            fit[i] = my - slope * mx
        away = np.abs(y - np.interp(x, at, fit))
        if 6 * np.median(away) <= 1e-7 * away.mean():
            break
        robust = np.clip(1 - (away / (6 * np.median(away))) ** 2, 0, None) ** 2
    return at, fit


def rows(spark, x, *ys):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, *ys, strict=True)], ", ".join(["x double", *(f"y{i} double" for i in range(len(ys)))]))


def agree(spark, x, ys, **options):
    got = trend.local_trend(rows(spark, x, *ys), [f"y{i}" for i in range(len(ys))], **options)
    for i, y in enumerate(ys):
        at, fit = plain(x, y, **options)
        assert got.x == pytest.approx(at, abs=0)
        assert got.y[:, i] == pytest.approx(fit, abs=1e-8)
    return got


def test_like_plain(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.gamma(2, 2, 600)
    curve = np.sin(x) + rng.normal(0, 0.1, 600)
    wild = np.where(rng.random(600) < 0.1, 30, 0.5 * x + rng.normal(0, 0.2, 600))
    found = agree(spark, x, [curve, wild])
    mid = found.x[(found.x > 1) & (found.x < 8)]
    assert found.at(mid)[:, 1] == pytest.approx(0.5 * mid, abs=0.2)  # outliers don't count
    monkeypatch.setattr(trend, "BINS", 7)  # nearly every row is in doubt
    agree(spark, x, [curve], span=0.11, rounds=1, n_anchors=9)


def test_ties(spark):
    """Half of the rows at one place, few places, a straight line, one place, two rows, one row."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros(100), rng.uniform(0, 5, 100)])
    agree(spark, x, [rng.normal(size=200)], rounds=2)
    x = rng.integers(0, 4, 90).astype(float)
    agree(spark, x, [rng.normal(size=90)], rounds=1)
    line = np.linspace(0, 9, 50)
    assert trend.local_trend(rows(spark, line, 2 * line - 1), ["y0"]).y[:, 0] == pytest.approx(2 * np.unique(line) - 1)
    assert trend.local_trend(rows(spark, [3, 3, 3], [1, 2, 6]), ["y0"], rounds=0).y.tolist() == [[3.0]]
    assert trend.local_trend(rows(spark, [1], [7]), ["y0"]).y.tolist() == [[7.0]]


def test_nothing(spark):
    df = rows(spark, [1, 2], [1, 2]).selectExpr("CAST(NULL AS double) AS x", "y0").union(rows(spark, [1], [float("nan")]))
    got = trend.local_trend(df, ["y0"])
    assert (len(got.x), got.y.shape) == (0, (0, 1))


def test_offsets_follow_abundance(spark):
    """One sample's counts grow faster with abundance than the others'."""
    rng = np.random.default_rng(3)
    level = 10 ** rng.uniform(1.5, 3.5, 400)
    y = rng.poisson(np.column_stack([level, level, level, level**1.15 / 3]))
    df = spark.createDataFrame([(f"v{i}", *map(int, r)) for i, r in enumerate(y)], "mutantName string, a int, x int, y0 int, d int")
    x, off = stats.csaw_offsets(df, ["a", "x", "y0", "d"])
    assert off.mean(1) == pytest.approx(0, abs=1e-12)
    slope = np.polyfit(x, off[:, 3] - off[:, 0], 1)[0]
    assert slope == pytest.approx(0.15 / (1 + 0.15 / 4), abs=0.03)
