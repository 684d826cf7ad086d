"""Special functions for the tests, vectorised with numpy, from published series and continued fractions."""

from __future__ import annotations

import numpy as np

#: Lanczos coefficients for g = 7 (fixed values).
LANCZOS = np.array([0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7])


def gammaln(x):
    """log Gamma for x > 0."""
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, 1 - x, x) - 1
    a = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    out = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(a)
    with np.errstate(all="ignore"):
        return np.where(small, np.log(np.pi / np.abs(np.sin(np.pi * x))) - out, out)


def _shifted(x, term, series):
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = np.where(low, out + term(x), out)
        x = np.where(low, x + 1, x)
    return out + series(x)


def digamma(x):
    return _shifted(x, lambda x: -1 / x, lambda x: np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8))


def trigamma(x):
    return _shifted(x, lambda x: 1 / x**2, lambda x: 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9))


def trigamma_inverse(y: float) -> float:
    """x > 0 with trigamma(x) = y, by Newton's method on 1 / trigamma, which is nearly linear."""
    if y > 1e7:
        return 1 / np.sqrt(y)
    if y < 1e-6:
        return 1 / y
    x = 0.5 + 1 / y
    for _ in range(60):
        t = float(trigamma(x))
        h = 1e-5 * x
        slope = (float(trigamma(x + h)) - float(trigamma(x - h))) / (2 * h)
        step = t * (1 - t / y) / slope
        x += step
        if abs(step) < 1e-10 * x:
            break
    return float(x)


def betainc(a, b, x):
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-14:
            break
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - gammaln(a) - gammaln(b) + gammaln(a + b)) / a
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.minimum(np.asarray(df, float), 1e8)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, df1, df2):
    f, df2 = np.maximum(np.asarray(f, float), 0), np.minimum(np.asarray(df2, float), 1e8)
    return betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_quantile(p: float, df):
    """The value below which a share p > 0.5 of the t distribution lies, by bisection."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(100):
        mid = (lo + hi) / 2
        low = 1 - t_two_sided(mid, df) / 2 < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.5, weights: np.ndarray | None = None, iterations: int = 3) -> np.ndarray:
    """Locally weighted lines with tricube weights and bisquare robustness; x must be sorted."""
    n = len(x)
    w0 = np.ones(n) if weights is None else weights
    k = max(2, min(n, int(np.ceil(span * n))))
    robust = np.ones(n)
    fit = np.array(y, float)
    for _ in range(iterations + 1):
        for i in range(n):
            dist = np.abs(x - x[i])
            reach = max(np.partition(dist, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (dist / (reach * 1.0001)) ** 3, 0, None) ** 3 * robust * w0
            sw = w.sum()
            if sw <= 0:
                continue
            mx, my = (w * x).sum() / sw, (w * y).sum() / sw
            sxx = (w * (x - mx) ** 2).sum()
            slope = (w * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-12 * sw else 0.0
            fit[i] = my + slope * (x[i] - mx)
        r = np.abs(y - fit)
        m = 6 * np.median(r)
        if m <= 0:
            break
        robust = np.clip(1 - (r / m) ** 2, 0, None) ** 2
    return fit
