"""Order statistics by counting in bins, and trimmed means of ratios, against sorting."""

import numpy as np
import pytest

from mavelake.operators import selection, stats


def frame(spark, groups):
    return spark.createDataFrame([(c, float(v)) for c, vs in groups.items() for v in vs], "c string, v double")


@pytest.mark.parametrize("bins", [2, 256])
def test_ranks(spark, monkeypatch, bins):
    """Ties, one value, a few, values of many sizes and signs."""
    monkeypatch.setattr(selection, "BINS", bins)
    rng = np.random.default_rng(1)
    groups = {"ties": rng.integers(0, 4, 300), "one": [7.5], "two": [-1, 1e300], "wide": np.concatenate([10 ** rng.uniform(-9, 9, 200), -rng.random(100)]), "same": [3] * 50}
    ranks = {c: sorted({0, len(v) // 3, len(v) // 2, len(v) - 1}) for c, v in groups.items()}
    got = selection.order_statistics(frame(spark, groups), ranks)
    assert got == {(c, k): float(np.sort(groups[c])[k]) for c in groups for k in ranks[c]}


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=101), "b": rng.integers(0, 9, 40), "c": [2.0]}
    got = selection.quantiles(frame(spark, groups), 0.75)
    assert got == pytest.approx({c: np.quantile(v, 0.75) for c, v in groups.items()})
    assert selection.quantiles(frame(spark, groups).where("false"), 0.5) == {}


def plain_tmm(y, trim_m=0.3, trim_a=0.05):
    y = y[y.max(1) > 0]
    lib = y.sum(0)
    q = np.quantile(y, 0.75, axis=0) / lib
    r = int(np.argmin(np.abs(q - q.mean())))
    out = np.zeros(len(lib))
    for i in range(len(lib)):
        both = (y[:, i] > 0) & (y[:, r] > 0)
        x, z = y[both, i], y[both, r]
        if i == r or not len(x):
            continue
        m, a = np.log2(x / lib[i] / (z / lib[r])), (np.log2(x / lib[i]) + np.log2(z / lib[r])) / 2
        v = (lib[i] - x) / lib[i] / x + (lib[r] - z) / lib[r] / z
        n = len(x)
        keep = np.ones(n, bool)
        for values, t in ((m, trim_m), (a, trim_a)):
            s = np.sort(values)
            keep &= (values >= s[int(n * t)]) & (values <= s[n - 1 - int(n * t)])
        out[i] = (m / v)[keep].sum() / (1 / v)[keep].sum() * np.log(2)
    return np.log(lib) + out - out.mean()


def test_tmm(spark):
    rng = np.random.default_rng(3)
    y = rng.poisson(10 ** rng.uniform(-0.5, 3, (250, 1)) * np.array([1.0, 2.0, 0.5, 1.3]))
    y[:40, 1] *= 8  # a few variants go up in one sample
    samples = list("abcd")
    df = spark.createDataFrame([(f"v{i}", *map(int, row)) for i, row in enumerate(y)], "mutantName string, a int, b int, c int, d int")
    assert stats.tmm(df, samples) == pytest.approx(plain_tmm(y.astype(float)), abs=1e-9)
    assert stats.tmm(df, ["a"]) == pytest.approx([np.log(y[:, 0].sum())])
