"""Scores and tests per variant. What variants share (library sizes, trends, priors) is a bounded summary on the driver;
each variant's own fit runs where its row is.

The linear-model path follows the published mean-variance weighting and empirical Bayes moderation. The count path is a
negative-binomial quasi-likelihood F test at dispersions that follow a trend over abundance (see `dispersion`), with
quasi-dispersions that are moderated towards a trend of their own.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import assert_scalar, assert_vector
from ..functions import special
from ..plans import ordered
from ..plans.scratch import cut
from . import dispersion
from .experiment import Experiment
from .selection import order_statistics, quantiles
from .trend import local_trend

TREND_BINS = 400


def fitness_frame(counts: DataFrame, col_data: DataFrame, pairing: str, condition: str, comparison: list[str], od_cols: list[str], variants: DataFrame, wt_rows: list[str] | None) -> DataFrame:
    """(mutantName, pair, fitness) from long counts (mutantName, sample, value) and sample annotations (Name, ...)."""
    od = F.lit(1.0)
    for c in od_cols:
        od = od * F.col(c).cast("double")
    cols = col_data.where(F.col(condition).isin(comparison[-2:])).select(F.col("Name").alias("sample"), F.col(pairing).alias("pair"), F.col(condition).alias("cond"), od.alias("od"))
    totals = counts.groupBy("sample").agg(F.sum("value").alias("total"))
    norm = counts.join(F.broadcast(cols), "sample").join(totals, "sample").select("mutantName", "pair", "cond", (F.col("value") * F.col("od") / F.col("total")).alias("norm"))
    num, den = (F.max(F.when(F.col("cond") == c, F.col("norm"))) for c in comparison[-2:])
    pairs = cols.groupBy("pair").agg(F.count_if(F.col("cond") == comparison[-2]).alias("a"), F.count_if(F.col("cond") == comparison[-1]).alias("b")).where("a > 0 AND b > 0").select("pair")
    both = norm.groupBy("mutantName", "pair").agg(num.alias("num"), den.alias("den"))
    dense = variants.select("mutantName").crossJoin(F.broadcast(pairs)).join(both, ["mutantName", "pair"], "left")  # replicates are few
    ratio = F.try_divide(F.coalesce("num", F.lit(0.0)), F.coalesce("den", F.lit(0.0)))
    logs = dense.select("mutantName", "pair", F.when(ratio > 0, F.log2(ratio)).alias("n"))
    if not wt_rows:
        return logs.select("mutantName", "pair", F.col("n").alias("fitness"))
    wt = logs.where(F.col("mutantName").isin(wt_rows)).groupBy("pair").agg(F.when(F.count("n") == F.count("*"), F.avg("n")).alias("wt"))
    return logs.join(F.broadcast(wt), "pair", "left").select("mutantName", "pair", F.try_divide("n", "wt").alias("fitness"))


def calculate_fitness_score(se: Experiment, pairingCol: str, ODCols: list[str], comparison: list[str], WTrows: list[str] | None, selAssay: str = "counts") -> DataFrame:
    """A column `{numerator}_vs_{denominator}_repl{pair}` for each replicate; comparison is (column, numerator, denominator)."""
    cols = se.col_data
    assert_scalar(pairingCol, "pairingCol", "character", valid_values=list(cols.columns))
    assert_vector(ODCols, "ODCols", "character", valid_values=list(cols.columns))
    assert_vector(comparison, "comparison", "character", length=3)
    assert_scalar(selAssay, "selAssay", "character", valid_values=se.assay_names())
    if comparison[0] not in cols.columns:
        raise ValueError("the first element of 'comparison' must be a column of colData")
    assert_vector(list(comparison[1:]), "comparison", "character", valid_values=list(cols[comparison[0]].astype(str)))
    own = cols[cols[comparison[0]].astype(str).isin(comparison[1:])]
    if (own.groupby([pairingCol, comparison[0]]).size() != 1).any():
        raise ValueError("there must be exactly one sample for each pairing value and condition")
    if WTrows is not None:
        known = {r.mutantName for r in se.row_data.where(F.col("mutantName").isin(list(WTrows))).select("mutantName").collect()}
        assert_vector(list(WTrows), "WTrows", "character", valid_values=known)
    spark = se.assays.sparkSession
    keep = own[["Name", pairingCol, comparison[0], *ODCols]].loc[:, lambda d: ~d.columns.duplicated()].astype({pairingCol: str, comparison[0]: str})
    long = fitness_frame(se.assay(selAssay), spark.createDataFrame(keep), pairingCol, comparison[0], list(comparison), list(ODCols), se.row_data, list(WTrows) if WTrows is not None else None)
    pairs = sorted(set(own[own[comparison[0]] == comparison[1]][pairingCol].astype(str)) & set(own[own[comparison[0]] == comparison[2]][pairingCol].astype(str)))
    wide = long.groupBy("mutantName").pivot("pair", pairs).agg(F.first("fitness"))
    return wide.select("mutantName", *(F.col(f"`{p}`").alias(f"{comparison[1]}_vs_{comparison[2]}_repl{p}") for p in pairs)).orderBy("mutantName")


def adjust_bh(df: DataFrame, p_col: str, out: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    Only distinct p-values with their counts are put in order, range by range.
    """
    counts = df.where(F.col(p_col).isNotNull()).groupBy(F.col(p_col).alias("_p")).agg(F.count("*").alias("n"))
    ranked = ordered.running(counts, [], [F.col("_p")], F.col("n"), "rank")
    total = F.lit(df.where(F.col(p_col).isNotNull()).count())
    adjusted = ordered.running(ranked, [], [F.desc("_p")], F.col("_p") * total / F.col("rank"), "least", F.min)
    adjusted = adjusted.select("_p", F.least(F.lit(1.0), F.col("least")).alias(out))
    return df.join(adjusted, df[p_col] == adjusted["_p"], "left").drop("_p")


def offsets(counts: DataFrame, samples: list[str], norm: str, wt_rows: list[str] | None) -> np.ndarray:
    """Log library sizes of the samples: effective ones, or relative to the wild-type rows."""
    if norm in ("geomean", "sum"):
        wt = counts.where(F.col("mutantName").isin(wt_rows))
        if norm == "sum":
            row = wt.agg(*(F.log(F.sum(s)).alias(s) for s in samples)).collect()[0]
        else:
            row = wt.where(F.least(*samples) > 0 if len(samples) > 1 else F.col(samples[0]) > 0).agg(*(F.avg(F.log(s)).alias(s) for s in samples)).collect()[0]
        off = np.array([row[s] for s in samples], float)
        lib = counts.agg(*(F.sum(s).alias(s) for s in samples)).collect()[0]
        return off - off.mean() + np.log(np.array([lib[s] for s in samples], float)).mean()
    return tmm(counts, samples)


def tmm_factors(counts: DataFrame, samples: list[str], trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """(sample, library, log_factor): each sample's library size and weighted mean of its log ratios to a reference sample, the
    one of most typical upper quartile. The shares trim_m of extreme ratios and trim_a of extreme abundances are left out; their
    cut points are exact order statistics."""
    spark = counts.sparkSession
    some = cut(counts.where(F.greatest(*samples) > 0 if len(samples) > 1 else F.col(samples[0]) > 0).select(*(F.col(s).cast("double").alias(s) for s in samples)))
    lib_row = some.agg(*(F.sum(s).alias(s) for s in samples)).collect()[0]
    lib = {s: lib_row[s] or 0.0 for s in samples}
    each = some.select(F.explode(F.array(*(F.struct(F.lit(s).alias("c"), F.col(s).alias("v")) for s in samples))).alias("x")).select("x.*")
    upper = quantiles(each, 0.75)
    share = np.array([upper.get(s, 0.0) / max(lib[s], 1) for s in samples])
    ref = samples[int(np.argmin(np.abs(share - share.mean())))]
    others = [F.struct(F.lit(s).alias("sample"), F.col(s).alias("x"), F.lit(lib[s]).alias("n")) for s in samples if s != ref]
    empty = spark.createDataFrame([(s, float(lib[s])) for s in samples], "sample string, library double")  # a row per sample
    if not others:
        return empty.withColumn("log_factor", F.lit(0.0))
    pairs = some.select(F.col(ref).alias("y"), F.explode(F.array(*others)).alias("p")).select("y", "p.*").where("x > 0 AND y > 0")
    x, y, big = F.col("x") / F.col("n"), F.col("y") / lib[ref], F.lit(lib[ref])
    var = (F.col("n") - F.col("x")) / F.col("n") / F.col("x") + (big - F.col("y")) / big / F.col("y")
    rows = cut(pairs.select("sample", F.log2(x / y).alias("m"), ((F.log2(x) + F.log2(y)) / 2).alias("a"), var.alias("v")))
    sizes = {r["sample"]: r.n for r in rows.groupBy("sample").agg(F.count("*").alias("n")).collect()}
    both = rows.select(F.explode(F.array(*(F.struct(F.concat_ws(":", F.lit(k), "sample").alias("c"), F.col(k).alias("v")) for k in "ma"))).alias("x")).select("x.*")
    ends = {f"{k}:{s}": [int(n * t), n - 1 - int(n * t)] for s, n in sizes.items() for k, t in (("m", trim_m), ("a", trim_a))}
    found = order_statistics(both, ends)
    cuts = [(s, *(found[f"{k}:{s}", ends[f"{k}:{s}"][i]] for k in "ma" for i in (0, 1))) for s in sizes]
    limits = spark.createDataFrame(cuts, "sample string, m_low double, m_high double, a_low double, a_high double")
    kept = rows.join(F.broadcast(limits), "sample").where("m BETWEEN m_low AND m_high AND a BETWEEN a_low AND a_high")
    means = kept.groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v")) * float(np.log(2))).alias("f"))
    return empty.join(means, "sample", "left").select("sample", "library", F.coalesce("f", F.lit(0.0)).alias("log_factor"))


def tmm(counts: DataFrame, samples: list[str], trim_m: float = 0.3, trim_a: float = 0.05) -> np.ndarray:
    """Log effective library sizes by trimmed means of M values; the factors' product is one."""
    rows = {r["sample"]: r for r in tmm_factors(counts, samples, trim_m, trim_a).collect()}
    lib, log_f = (np.array([rows[s][c] for s in samples], float) for c in ("library", "log_factor"))
    return np.log(lib) + log_f - log_f.mean()


def csaw_offsets(counts: DataFrame, samples: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Abundance-dependent offsets: each sample's log deviation from the mean log abundance as a local regression on it. The
    abundances of the anchors, in order, and the offsets there, whose mean over the samples is nothing."""
    lib = np.exp(tmm(counts, samples))
    logs = [F.log(F.col(s) + 0.5 * lib[i] / lib.mean()) for i, s in enumerate(samples)]
    mean = sum(logs[1:], logs[0]) / len(samples)
    names = [f"y{i}" for i in range(len(samples))]
    rows = counts.select(mean.alias("x"), *((v - mean).alias(c) for v, c in zip(logs, names, strict=True)))
    found = local_trend(rows, names)
    return found.x, found.y - found.y.mean(1, keepdims=True)


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield fn(p)

    return df.mapInPandas(run, schema)


def squeeze(s2: DataFrame, df: float) -> tuple[float, float]:
    """Prior degrees of freedom and variance from residual variances (column s2), by moments of their logs."""
    e = F.log("s2") - float(special.digamma(df / 2)) + float(np.log(df / 2))
    row = s2.where("s2 > 1e-15").agg(F.avg(e).alias("m"), F.var_samp(e).alias("v")).collect()[0]
    if row.m is None:
        return float("inf"), 1.0
    extra = (row.v or 0) - float(special.trigamma(df / 2))
    if extra > 0:
        d0 = 2 * special.trigamma_inverse(extra)
        return d0, float(np.exp(row.m + special.digamma(d0 / 2) - np.log(d0 / 2)))
    return float("inf"), float(np.exp(row.m))


def _contrast(design: np.ndarray, coef: list[int] | None, contrast: np.ndarray | None) -> np.ndarray:
    if contrast is not None:
        return np.asarray(contrast, float).reshape(-1, 1)
    return np.eye(design.shape[1])[:, coef]


def limma_test(counts: DataFrame, samples: list[str], design: np.ndarray, contrast: np.ndarray, log_lib: np.ndarray) -> DataFrame:
    """Moderated t statistics of one contrast with observation weights from the trend of residual spread."""
    n, p = design.shape
    lib = np.exp(log_lib)
    dof = n - p
    hat = np.linalg.pinv(design)

    def log_cpm(pdf: pd.DataFrame) -> np.ndarray:
        return np.log2((pdf[samples].to_numpy(float) + 0.5) / (lib + 1) * 1e6)

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        y = log_cpm(pdf)
        r = y - y @ hat.T @ design.T
        x = y.mean(1) + np.log2(lib + 1).mean() - np.log2(1e6)
        some = pdf[samples].to_numpy(float).sum(1) > 0
        return pd.DataFrame({"x": x[some], "y": (r**2).sum(1)[some] ** 0.25 / max(dof, 1) ** 0.25})

    points = cut(_map(counts, spread, "x double, y double"))
    edges = np.unique(points.approxQuantile("x", np.linspace(0, 1, TREND_BINS + 1).tolist(), 0.0005)) if not points.isEmpty() else np.array([0.0])
    place = F.width_bucket("x", F.lit(float(edges[0])), F.lit(float(edges[-1]) + 1e-9), F.lit(TREND_BINS))
    rows = points.groupBy(place.alias("b")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("x").collect()
    tx = np.array([r.x for r in rows])
    ty = special.lowess(tx, np.array([r.y for r in rows]), 0.5, np.array([r.n for r in rows], float)) if len(rows) > 2 else np.array([r.y for r in rows])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = log_cpm(pdf)
        fitted = y @ hat.T @ design.T
        level = fitted + np.log2(lib + 1) - np.log2(1e6)
        w = 1 / np.maximum(np.interp(level, tx, ty), 1e-6) ** 4
        a = np.einsum("ij,jk,jl->ikl", w, design, design)
        inv = np.linalg.inv(a)
        beta = np.einsum("ikl,il->ik", inv, (w * y) @ design)
        s2 = (w * (y - beta @ design.T) ** 2).sum(1) / max(dof, 1)
        c = contrast[:, 0]
        return pd.DataFrame({"mutantName": pdf["mutantName"], "logFC": beta @ c, "unscaled": np.sqrt(np.einsum("k,ikl,l->i", c, inv, c)), "AveExpr": y.mean(1), "s2": s2})

    fits = cut(_map(counts, fit, "mutantName string, logFC double, unscaled double, AveExpr double, s2 double"))
    d0, s0 = squeeze(fits, dof)
    n_rows = fits.count()
    total = min(dof + d0, dof * n_rows)
    prior_var = _prior_variance(fits, d0, s0, dof, total)
    half = float(special.t_quantile(0.975, np.array(total)))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        post = np.full(len(pdf), s0) if np.isinf(d0) else (d0 * s0 + dof * pdf["s2"]) / (d0 + dof)
        se = np.sqrt(post) * pdf["unscaled"]
        t = pdf["logFC"] / se
        r = (pdf["unscaled"] ** 2 + prior_var) / pdf["unscaled"] ** 2
        kernel = t**2 * (1 - 1 / r) / 2 if total > 1e6 else (1 + total) / 2 * np.log((t**2 + total) / (t**2 / r + total))
        b = np.log(0.01 / 0.99) - np.log(r) / 2 + kernel
        return pd.DataFrame({"mutantName": pdf["mutantName"], "logFC": pdf["logFC"], "CI_L": pdf["logFC"] - half * se, "CI_R": pdf["logFC"] + half * se, "AveExpr": pdf["AveExpr"], "t": t, "P_Value": special.t_two_sided(t, total), "B": b, "se_logFC": se, "df_total": float(total), "df_prior": float(d0)})

    out = _map(fits, test, "mutantName string, logFC double, CI_L double, CI_R double, AveExpr double, t double, P_Value double, B double, se_logFC double, df_total double, df_prior double")
    return adjust_bh(cut(out), "P_Value", "adj_P_Val")


def _prior_variance(fits: DataFrame, d0: float, s0: float, dof: float, total: float, share: float = 0.01) -> float:
    """Variance of true effects relative to their errors, from the largest moderated t statistics."""
    post = F.lit(s0) if np.isinf(d0) else (F.lit(d0 * s0) + dof * F.col("s2")) / (d0 + dof)
    t = F.abs(F.col("logFC") / F.sqrt(post) / F.col("unscaled"))
    n = fits.count()
    k = max(1, min(1000, int(np.ceil(share / 2 * n))))
    top = fits.select(t.alias("t"), "unscaled").orderBy(F.desc("t")).limit(k).collect()
    ratio = []
    for i, r in enumerate(top):
        q = float(special.t_quantile(1 - min(0.49, (i + 0.5) / n / share / 2), np.array(total)))
        ratio.append(max(0.0, (r.t**2 / max(q, 1e-6) ** 2 - 1)) * r.unscaled**2)
    return float(np.clip(np.mean(ratio) if ratio else 0.0, 0.01, 16.0))


def ql_test(counts: DataFrame, samples: list[str], design: np.ndarray, contrast: np.ndarray, log_lib: np.ndarray, pseudocount: float, trend: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Quasi-likelihood F test of the contrasts (columns), at trended dispersions."""
    n, p = design.shape
    dof, tests = n - p, contrast.shape[1]
    lib = np.exp(log_lib)

    def off(y: np.ndarray) -> np.ndarray:
        if trend is None:
            return log_lib
        a = np.log(y + 0.5 * lib / lib.mean()).mean(1)
        return log_lib.mean() + np.column_stack([np.interp(a, trend[0], trend[1][:, j]) for j in range(n)])

    over, _, own = dispersion.estimate(counts, samples, design, log_lib, off)
    # the null design: the part of the column space that leaves the contrasts at zero
    q = np.linalg.qr(contrast, mode="complete")[0]
    turned = design @ q
    null = turned[:, tests:] if tests < p else np.zeros((n, 0))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[samples].to_numpy(float)
        o = off(y)
        x = dispersion.abundance(y, lib)
        phi = over.at(x)[:, None]
        beta, mu = dispersion.nb_fit(y, o, design, phi)
        if null.shape[1]:
            _, mu0 = dispersion.nb_fit(y, o, null, phi)
        else:
            mu0 = np.broadcast_to(np.exp(o), y.shape)
        add = pseudocount * lib / lib.mean()
        shrunk, _ = dispersion.nb_fit(y + add, np.log(np.exp(np.broadcast_to(o, y.shape)) + 2 * add), design, phi)
        dev = dispersion.deviance(y, mu, phi)
        return pd.DataFrame({"mutantName": pdf["mutantName"], "logFC": beta @ contrast[:, 0] / np.log(2), "shrunk": shrunk @ contrast[:, 0] / np.log(2), "logCPM": np.log2((y + 2 * add) / (lib + 2 * add) * 1e6).mean(1), "x": x, "s2": dev / max(dof, 1), "lr": np.maximum(dispersion.deviance(y, mu0, phi) - dev, 0)})

    fits = cut(_map(counts, fit, "mutantName string, logFC double, shrunk double, logCPM double, x double, s2 double, lr double"))
    prior = dispersion.squeeze_over(fits, dof)
    d0 = prior.df
    total = min(dof + d0, dof * fits.count())

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        s0 = prior.variance(pdf["x"].to_numpy())
        post = s0 if np.isinf(d0) else (d0 * s0 + dof * pdf["s2"]) / (d0 + dof)
        f = pdf["lr"] / tests / np.maximum(post, 1e-12)
        return pd.DataFrame({"mutantName": pdf["mutantName"], "logFC": pdf["logFC"], "logCPM": pdf["logCPM"], "F": f, "PValue": special.f_upper(f, tests, total), "logFC_shrunk": pdf["shrunk"], "df_total": float(total), "df_prior": float(d0), "df_test": float(tests)})

    schema = "mutantName string, logFC double, logCPM double, F double, PValue double, logFC_shrunk double, df_total double, df_prior double, df_test double"
    return adjust_bh(cut(_map(fits, test, schema).join(own, "mutantName")), "PValue", "FDR")


def calculate_relative_fc(se: Experiment, design: np.ndarray, coef: int | list[int] | None = None, contrast: np.ndarray | None = None, WTrows: list[str] | None = None, selAssay: str = "counts", pseudocount: float = 1, method: str = "edgeR", normMethod: str | None = None) -> DataFrame:
    """One row per variant. Columns with a dot in their public names have an underscore here (P_Value, df_total ...)."""
    normMethod = normMethod or ("TMM" if WTrows is None else "sum")
    names = se.assay_names()
    if names == [""] and selAssay:
        warnings.warn("the only assay has no name: it is taken for 'selAssay'", stacklevel=2)
        selAssay = ""
    assert_scalar(selAssay, "selAssay", "character", valid_values=names)
    design = np.asarray(design, float)
    if len(design) != len(se.samples):
        raise ValueError(f"'design' has {len(design)} rows for {len(se.samples)} samples")
    assert_scalar(pseudocount, "pseudocount", "numeric", rng_incl=(0, float("inf")))
    assert_scalar(method, "method", "character", valid_values=["edgeR", "limma"])
    if normMethod in ("csaw", "TMM") and WTrows is not None:
        raise ValueError(f"normMethod '{normMethod}' takes no WTrows")
    if normMethod in ("sum", "geomean") and WTrows is None:
        raise ValueError(f"normMethod '{normMethod}' needs WTrows")
    if normMethod == "csaw" and method == "limma":
        raise ValueError("normMethod 'csaw' needs method 'edgeR'")
    assert_scalar(normMethod, "normMethod", "character", valid_values=["csaw", "TMM", "geomean", "sum"])
    if coef is None and contrast is None:
        raise ValueError("a test takes 'coef' or 'contrast'")
    if contrast is not None and np.ndim(contrast) != 1:
        raise ValueError("'contrast' takes one number for each column of 'design'")
    if WTrows is not None:
        known = {r.mutantName for r in se.row_data.where(F.col("mutantName").isin(list(WTrows))).select("mutantName").collect()}
        assert_vector(list(WTrows), "WTrows", "character", valid_values=known)
    c = _contrast(design, None if coef is None else np.atleast_1d(coef).tolist(), contrast)
    counts = cut(se.dense(selAssay))
    trend = csaw_offsets(counts, se.samples) if normMethod == "csaw" else None
    log_lib = offsets(counts, se.samples, normMethod, list(WTrows or []))
    if method == "limma":
        return limma_test(counts, se.samples, design, c, log_lib)
    return ql_test(counts, se.samples, design, c, log_lib, pseudocount, trend)
