"""Kernel densities from grids against sums over all rows."""

import numpy as np
import pandas as pd
import pytest

from mavelake.operators import density as D


def width(x, factor):
    sd = np.std(x, ddof=1) if len(x) > 1 else 0.0
    return factor * (min(sd, (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) or sd or 1.0) * len(x) ** -0.2


def bell(d, h):
    return np.exp(-0.5 * (d / h) ** 2) / (h * np.sqrt(2 * np.pi))


def snap(x, n):
    """Values at their nearest grid points."""
    lo, hi = x.min(), x.max()
    return lo + np.floor((x - lo) / ((hi - lo) or 1) * (n - 1) + 0.5) * ((hi - lo) or 1) / (n - 1)


def wide_of(spark, columns):
    pdf = pd.DataFrame(columns).astype(float)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf))


def test_pairs_like_plain(spark):
    """Correlated, spread out and constant samples; names that need quotes."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=500)
    columns = {"a": a, "b.1": a + rng.gamma(1, 1, 500), "same": np.full(500, 2.0)}
    got = D.pair_density(wide_of(spark, columns), list(columns), 21).toPandas()
    assert len(got) == 3 * 21 * 21
    for (s, t), part in got.groupby(["sample1", "sample2"]):
        x, y = columns[s], columns[t]
        hx, hy = width(x, 1.06), width(y, 1.06)
        for r in part.itertuples():
            exact = (bell(r.x - snap(x, 21), hx) * bell(r.y - snap(y, 21), hy)).mean()
            assert r.density == pytest.approx(exact, abs=1e-12)
    fine = D.pair_density(wide_of(spark, {k: columns[k] for k in ("a", "b.1")}), ["a", "b.1"], 200).toPandas()
    step = [np.ptp(columns[k]) / 199 for k in ("a", "b.1")]
    inside = fine.density.sum() * step[0] * step[1]
    assert 0.9 < inside <= 1.001  # what the kernels put outside of the range is lost
    some = fine.iloc[::977]
    whole = [(bell(r.x - a, width(a, 1.06)) * bell(r.y - columns["b.1"], width(columns["b.1"], 1.06))).mean() for r in some.itertuples()]
    assert some.density.to_numpy() == pytest.approx(whole, abs=2e-3)


def test_missing_values(spark):
    """A row counts for the pairs whose values it has; a pair without such a row has no density."""
    nan = float("nan")
    columns = {"a": [1.0, 2.0, nan, nan], "b": [0.0, 1.0, 5.0, nan], "c": [nan, nan, nan, 3.0]}
    counts = D.pair_counts(wide_of(spark, columns), ["a", "b", "c"], 5).toPandas()
    assert sorted(map(tuple, counts[["sample1", "sample2", "i", "j", "n"]].to_numpy())) == [("a", "b", 0, 0, 1), ("a", "b", 4, 1, 1)]
    assert set(D.pair_density(wide_of(spark, columns), ["a", "b", "c"], 5).toPandas().sample2) == {"b"}
    assert D.pair_density(wide_of(spark, columns), ["a"], 5).count() == 0
    assert D.pair_density(wide_of(spark, columns).where("false"), ["a", "b"], 5).count() == 0
    with pytest.raises(ValueError, match="at least 2"):
        D.pair_density(wide_of(spark, columns), ["a", "b"], 1)


def test_one_dimension(spark):
    rng = np.random.default_rng(2)
    x = {"u": rng.normal(size=400), "v": rng.normal(3, 0.5, 100)}
    df = spark.createDataFrame([(s, float(v)) for s, vs in x.items() for v in vs] + [("u", None), ("u", float("nan"))], "sample string, x double")
    got = D.density(df).toPandas()
    both = np.concatenate(list(x.values()))
    for s, part in got.groupby("sample"):
        assert (part.x.min(), part.x.max()) == pytest.approx((both.min(), both.max()))
        exact = bell(part.x.to_numpy()[:, None] - x[s], width(x[s], 0.9)).mean(1)
        assert part.density.to_numpy() == pytest.approx(exact, abs=5e-3)  # what snapping to the grid may change
        step = np.ptp(both) / 511
        at = both.min() + np.floor((x[s] - both.min()) / step + 0.5) * step
        assert part.density.to_numpy() == pytest.approx(bell(part.x.to_numpy()[:, None] - at, width(x[s], 0.9)).mean(1), abs=1e-9)
    assert D.density(df.where("false")).count() == 0
