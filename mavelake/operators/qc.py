"""Quality control: the data behind each plot as a DataFrame, charts as small SVG, and one HTML report.

Only bounded aggregates (per sample and step, per bin, per pair of samples, or a stated number of top rows) reach the
driver.
"""

from __future__ import annotations

import html
import os
import platform
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checks import assert_scalar, assert_vector
from ..plans import ordered
from .density import density, pair_counts, pair_density
from .experiment import Experiment, knee_ranks
from .reads import FILTERS

STEPS = ["nbrTotal", *FILTERS, "nbrRetained"]
#: Pixels a side of scatter plots that show numbers of points.
PIXELS = 512


def filtering_frame(summary: DataFrame, only_active: bool = True) -> DataFrame:
    """(sample, step, step_idx, nbrReads, fracReads, cumulNbr, cumulFrac) from a row of counters per sample (Name, ...).

    cumulNbr is what remains after the step; shares are of all reads, to three significant digits.
    """
    long = summary.unpivot("Name", STEPS, "step", "nbrReads").withColumnRenamed("Name", "sample")
    index = F.create_map(*(F.lit(x) for kv in zip(STEPS, range(len(STEPS)), strict=True) for x in kv))
    long = long.withColumn("step_idx", index[F.col("step")])
    if only_active:
        seen = long.groupBy("step").agg(F.max("nbrReads").alias("m")).where((F.col("m") > 0) | F.col("step").isin("nbrTotal", "nbrRetained"))
        long = long.join(F.broadcast(seen.select("step")), "step")  # at most sixteen rows
    own = Window.partitionBy("sample")
    total = F.max(F.when(F.col("step") == "nbrTotal", F.col("nbrReads"))).over(own)
    lost = F.when(F.col("step").isin("nbrTotal", "nbrRetained"), 0).otherwise(F.col("nbrReads"))
    gone = F.sum(lost).over(own.orderBy("step_idx").rowsBetween(Window.unboundedPreceding, 0))
    out = long.withColumn("total", total).withColumn("cumulNbr", (F.col("total") - gone).cast("long"))
    return out.select("sample", "step", "step_idx", F.col("nbrReads").cast("long").alias("nbrReads"), signif(F.try_divide("nbrReads", "total")).alias("fracReads"), "cumulNbr", signif(F.try_divide("cumulNbr", "total")).alias("cumulFrac"))


def signif(c, digits: int = 3):
    """c to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def check_filtering(summary: DataFrame) -> None:
    """Raise unless, for every sample, all reads less the filtered ones are those retained, and columns are in order."""
    have = [c for c in summary.columns if c in STEPS]
    if have != STEPS:
        raise ValueError("the columns of filter counters are missing or not in order")
    lost = sum((F.col(f) for f in FILTERS[1:]), F.col(FILTERS[0]))
    if not summary.where(F.col("nbrTotal") - lost != F.col("nbrRetained")).isEmpty():
        raise ValueError("the filter counters don't add up to the retained reads")


def plot_filtering(se: Experiment, valueType: str = "reads", onlyActiveFilters: bool = True, displayNumbers: bool = True, numberSize: float = 4, plotType: str = "remaining", facetBy: str = "sample") -> DataFrame:
    assert_scalar(valueType, "valueType", "character", valid_values=["reads", "fractions"])
    assert_scalar(onlyActiveFilters, "onlyActiveFilters", "logical")
    assert_scalar(displayNumbers, "displayNumbers", "logical")
    assert_scalar(numberSize, "numberSize", "numeric", rng_excl=(0, float("inf")))
    assert_scalar(plotType, "plotType", "character", valid_values=["remaining", "filtered"])
    assert_scalar(facetBy, "facetBy", "character", valid_values=["sample", "step"])
    summary = se.assays.sparkSession.createDataFrame(se.col_data[["Name", *STEPS]])
    check_filtering(summary)
    data = filtering_frame(summary, onlyActiveFilters)
    y = {("reads", "remaining"): "cumulNbr", ("fractions", "remaining"): "cumulFrac", ("reads", "filtered"): "nbrReads", ("fractions", "filtered"): "fracReads"}[valueType, plotType]
    if plotType == "remaining":
        data = data.where("step <> 'nbrRetained'")
    else:
        data = data.where("step NOT IN ('nbrTotal', 'nbrRetained')")
    return data.select("sample", "step", "step_idx", F.col(y).cast("double").alias("value"), F.col(facetBy).alias("facet"), F.lit(displayNumbers).alias("labelled")).orderBy("facet", "step_idx", "sample")


def plot_totals(se: Experiment, selAssay: str = "counts", groupBy: str | None = None) -> DataFrame:
    """Sum of the assay per sample and, if named, per value of a row annotation."""
    assert_scalar(selAssay, "selAssay", "character", valid_values=se.assay_names())
    assert_scalar(groupBy, "groupBy", "character", allow_null=True, valid_values=se.row_data.columns)
    a = se.assay(selAssay)
    if groupBy is None:
        return a.groupBy("sample").agg(F.sum("value").alias("total")).orderBy("sample")
    return a.join(se.row_data.select("mutantName", F.col(groupBy).alias("group")), "mutantName").groupBy("sample", "group").agg(F.sum("value").alias("total")).orderBy("sample", "group")


def _long(se: Experiment, assay: str) -> DataFrame:
    """All values, absent counts as zeros: samples are few, so each variant is repeated once per sample."""
    names = se.assays.sparkSession.createDataFrame([(s,) for s in se.samples], "sample string")
    full = se.row_data.select("mutantName").crossJoin(F.broadcast(names))
    return full.join(se.assay(assay), ["mutantName", "sample"], "left").select("mutantName", "sample", F.coalesce("value", F.lit(0.0)).alias("value"))


def histogram_frame(values: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """(sample, bin, lower, n) of column x in equal bins."""
    width = (hi - lo) / bins or 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) / width).cast("int"))
    return values.where(F.col("x").isNotNull()).groupBy("sample", b.alias("bin")).agg(F.count("*").alias("n")).withColumn("lower", F.lit(lo) + F.col("bin") * width)


def plot_distributions(se: Experiment, selAssay: str = "counts", groupBy: str | None = None, plotType: str = "density", facet: bool = False, pseudocount: float = 0) -> DataFrame:
    """density: (sample, x, density); knee: (sample, idx, value); histogram: (sample, bin, lower, n). x is log10."""
    assert_scalar(selAssay, "selAssay", "character", valid_values=se.assay_names())
    assert_scalar(groupBy, "groupBy", "character", allow_null=True, valid_values=list(se.col_data.columns))
    assert_scalar(plotType, "plotType", "character", valid_values=["density", "histogram", "knee"])
    assert_scalar(facet, "facet", "logical")
    assert_scalar(pseudocount, "pseudocount", "numeric", rng_incl=(0, float("inf")))
    values = _long(se, selAssay).withColumn("value", F.col("value") + pseudocount)
    if plotType == "knee":
        out = knee_ranks(values).where("value > 0").select("sample", "mutantName", "idx", "value")
    else:
        logs = values.where("value > 0").select("sample", F.log10("value").alias("x"))
        row = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()[0]
        lo, hi = (row.lo, row.hi) if row.lo is not None else (0.0, 1.0)
        if plotType == "histogram":
            out = histogram_frame(logs, 50 if facet else 30, lo, hi)
        else:
            out = density(logs)
    if groupBy and groupBy != "Name":
        cols = se.assays.sparkSession.createDataFrame(se.col_data[["Name", groupBy]].astype(str)).toDF("sample", "group")
        out = out.join(F.broadcast(cols), "sample", "left")
    return out


def correlations(wide: DataFrame, samples: list[str], method: str = "pearson") -> DataFrame:
    """(sample1, sample2, cor) for all pairs; Spearman is Pearson of average ranks. One pass over the rows for all pairs."""
    if method == "spearman":
        for s in samples:
            counts = wide.groupBy(F.col(s).alias("_v")).agg(F.count("*").alias("_n"))
            ranks = ordered.running(counts, [], [F.col("_v")], F.col("_n"), "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias("_r"))
            wide = wide.join(ranks, wide[s] == ranks["_v"]).drop("_v", s).withColumnRenamed("_r", s)
    pairs = [(a, b) for i, a in enumerate(samples) for b in samples[i + 1 :]]
    row = wide.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).select(F.explode(F.array(*(F.struct(F.lit(a).alias("sample1"), F.lit(b).alias("sample2"), F.col(f"c{i}").alias("cor")) for i, (a, b) in enumerate(pairs)))).alias("r"))
    return row.select("r.*")


def plot_pairs(se: Experiment, selAssay: str = "counts", doLog: bool = True, pseudocount: float = 1, corMethod: str = "pearson", histBreaks: int = 40, pointsType: str = "points", corSizeMult: float = 5, corSizeAdd: float = 2, pointSize: float = 0.1, pointAlpha: float = 0.3, colorByCorrelation: bool = True, corrColorRange: list[float] | None = None, addIdentityLine: bool = False) -> dict:
    """Correlations, histograms, what the scatter plots show, and the colour range of the correlations.

    The points are the values themselves (a DataFrame); "smoothscatter" adds a two-dimensional density whose fourth root is the
    fill, and "scattermore" and "scattermost" add the numbers of points by pixel, so no plot needs all rows."""
    assert_scalar(selAssay, "selAssay", "character", valid_values=se.assay_names())
    assert_scalar(corMethod, "corMethod", "character", valid_values=["pearson", "spearman"])
    assert_scalar(pointsType, "pointsType", "character", valid_values=["smoothscatter", "points", "scattermore", "scattermost"])
    for n, v in (("corSizeMult", corSizeMult), ("pointSize", pointSize), ("pointAlpha", pointAlpha)):
        assert_scalar(v, n, "numeric", rng_excl=(0, float("inf")))
    assert_scalar(corSizeAdd, "corSizeAdd", "numeric", rng_incl=(0, float("inf")))
    assert_scalar(pseudocount, "pseudocount", "numeric", rng_incl=(0, float("inf")))
    assert_scalar(histBreaks, "histBreaks", "numeric", rng_excl=(0, float("inf")))
    for n, v in (("doLog", doLog), ("colorByCorrelation", colorByCorrelation), ("addIdentityLine", addIdentityLine)):
        assert_scalar(v, n, "logical")
    if corrColorRange is not None:
        assert_vector(corrColorRange, "corrColorRange", "numeric", rng_incl=(0, 1), length=2)
        if corrColorRange[0] > corrColorRange[1]:
            raise ValueError("corrColorRange[2] must be at least corrColorRange[1]")
    samples = se.samples
    value = lambda s: F.col(s) + pseudocount
    wide = se.dense(selAssay).select("mutantName", *((F.when(value(s) > 0, F.log10(value(s))) if doLog else value(s)).alias(s) for s in samples))
    cor = correlations(wide, samples, corMethod)
    if corrColorRange is None:
        seen = [abs(r.cor) for r in cor.collect() if r.cor is not None]
        lo, hi = (max(0.0, min(seen)), min(1.0, max(seen))) if seen else (0.0, 1.0)
        corrColorRange = [lo, hi] if hi > lo else [0.0, 1.0]
    long = wide.unpivot("mutantName", samples, "sample", "x")
    row = long.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()[0]
    hist = histogram_frame(long, int(histBreaks), row.lo or 0.0, row.hi if row.hi is not None else 1.0)
    out = {"correlations": cor, "histograms": hist, "values": wide, "colorRange": corrColorRange, "identityLine": addIdentityLine and pointsType != "smoothscatter"}
    if len(samples) > 1 and pointsType == "smoothscatter":
        out["density"] = pair_density(wide, samples).withColumn("fill", F.pow("density", F.lit(0.25)))
    elif len(samples) > 1 and pointsType != "points":
        out["pixels"] = pair_counts(wide, samples, PIXELS).select("sample1", "sample2", "i", "j", "n")
    return out


#: Column names that results of different tests use, most specific first (fixed values).
COLUMNS = {"logFC": ["logFC_shrunk", "logFC"], "p": ["PValue", "P_Value"], "padj": ["FDR", "adj_P_Val"], "mean": ["logCPM", "AveExpr"]}


def column_of(df: DataFrame, what: str) -> str:
    for c in COLUMNS[what]:
        if c in df.columns:
            return c
    raise ValueError(f"no column for '{what}': one of {', '.join(COLUMNS[what])} is needed")


def _scatter(results: DataFrame, x: str, y: str, padjThreshold: float, nTopToLabel: int, pointSize: str) -> DataFrame:
    assert_scalar(padjThreshold, "padjThreshold", "numeric", rng_incl=(0, 1))
    assert_scalar(nTopToLabel, "nTopToLabel", "numeric", rng_incl=(0, float("inf")))
    assert_scalar(pointSize, "pointSize", "character", valid_values=["large", "small"])
    p, padj = column_of(results, "p"), column_of(results, "padj")
    top = results.where(F.col(p).isNotNull()).orderBy(p, "mutantName").limit(int(nTopToLabel)).select("mutantName", F.lit(True).alias("labelled"))
    height = -F.log10(F.greatest(F.col(p), F.lit(1e-300))) if y == "neglog" else F.col(y)
    out = results.select("mutantName", F.col(x).alias("x"), height.alias("y"), (F.coalesce(F.col(padj), F.lit(1.0)) < padjThreshold).alias("significant"))
    return out.join(F.broadcast(top), "mutantName", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def plot_mean_diff(results: DataFrame, padjThreshold: float = 0.05, pointSize: str = "small", interactivePlot: bool = False, nTopToLabel: int = 0) -> DataFrame:
    """Mean abundance (x) against log fold change (y), with significance and labels of the smallest p-values."""
    return _scatter(results, column_of(results, "mean"), column_of(results, "logFC"), padjThreshold, nTopToLabel, pointSize)


def plot_volcano(results: DataFrame, padjThreshold: float = 0.05, pointSize: str = "small", interactivePlot: bool = False, nTopToLabel: int = 0) -> DataFrame:
    """Log fold change (x) against -log10 p (y), likewise."""
    return _scatter(results, column_of(results, "logFC"), "neglog", padjThreshold, nTopToLabel, pointSize)


def bars(labels: list[str], values: list[float], width: int = 640) -> str:
    """A horizontal bar chart as SVG."""
    top = max([1e-12, *map(abs, values)])
    rows = [f'<text x="0" y="{18 * i + 13}" font-size="11">{html.escape(str(n))}</text><rect x="220" y="{18 * i + 3}" width="{(width - 320) * abs(v) / top:.1f}" height="12" fill="#4477aa"/><text x="{225 + (width - 320) * abs(v) / top:.1f}" y="{18 * i + 13}" font-size="11">{v:g}</text>' for i, (n, v) in enumerate(zip(labels, values, strict=True))]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{18 * len(values) + 6}">{"".join(rows)}</svg>'


def lines(series: dict[str, tuple[list[float], list[float]]], width: int = 640, height: int = 300) -> str:
    """A line chart of some series as SVG."""
    xs, ys = ([v for s in series.values() for v in s[k] if np.isfinite(v)] for k in (0, 1))
    if not xs:
        return ""
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    at = lambda v, a, b, n: n * (v - a) / ((b - a) or 1)
    colours = ["#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb"]
    out = []
    for i, (name, (x, y)) in enumerate(series.items()):
        path = " ".join(f"{at(a, x0, x1, width - 160):.1f},{height - at(b, y0, y1, height - 20):.1f}" for a, b in zip(x, y, strict=True))
        out.append(f'<polyline fill="none" stroke="{colours[i % 7]}" points="{path}"/><text x="{width - 150}" y="{14 * i + 14}" font-size="11" fill="{colours[i % 7]}">{html.escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(out)}</svg>'


def generate_qc_report(se: Experiment, outFile: str, reportTitle: str = "QC report", forceOverwrite: bool = False, **_: object) -> str:
    """Write a self-contained HTML report; a section that fails says so and the others go on."""
    if not isinstance(se, Experiment):
        raise TypeError("'se' must be an Experiment")
    assert_scalar(outFile, "outFile", "character")
    assert_scalar(reportTitle, "reportTitle", "character")
    assert_scalar(forceOverwrite, "forceOverwrite", "logical")
    if not outFile.endswith(".html"):
        raise ValueError("'outFile' must end with .html")
    if os.path.exists(outFile) and not forceOverwrite:
        raise FileExistsError(f"{outFile} is there already, and 'forceOverwrite' is off")
    os.makedirs(os.path.dirname(os.path.abspath(outFile)), exist_ok=True)

    def overview() -> str:
        n = se.row_data.count()
        return f"<p>{n} variants, {len(se.samples)} samples, assays: {', '.join(map(html.escape, se.assay_names()))}</p>"

    def annotation() -> str:
        parameters = se.metadata.get("parameters") or {}
        extra = pd.DataFrame([{"Name": n, "mutNameDelimiter": p.get("mutNameDelimiter"), "mergeForwardReverse": p.get("mergeForwardReverse")} for n, p in parameters.items()])
        table = se.col_data.merge(extra, on="Name", how="outer") if len(extra) else se.col_data
        return table.to_html(index=False)

    def filtering(kind: str) -> str:
        data = plot_filtering(se, valueType=kind).toPandas()
        return "".join(f"<h3>{html.escape(str(s))}</h3>" + bars(list(p["step"]), list(p["value"])) for s, p in data.groupby("sample"))

    def pairs() -> str:
        return plot_pairs(se)["correlations"].toPandas().to_html(index=False)

    def totals() -> str:
        data = plot_totals(se).toPandas()
        return bars(list(data["sample"]), list(data["total"]))

    def knee() -> str:
        data = plot_distributions(se, plotType="knee").where(F.log2("idx") % 0.25 < 0.05).toPandas().sort_values("idx")
        return lines({str(s): (list(np.log10(p["idx"])), list(np.log10(p["value"]))) for s, p in data.groupby("sample")})

    def density() -> str:
        data = plot_distributions(se, plotType="density", pseudocount=1).toPandas()
        return lines({str(s): (list(p["x"]), list(p["density"])) for s, p in data.groupby("sample")})

    def session() -> str:
        return f"<pre>{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} UTC, Python {platform.python_version()}, Spark {se.assays.sparkSession.version}</pre>"

    sections = [("Object", overview), ("Samples", annotation), ("Filtering (reads)", lambda: filtering("reads")), ("Filtering (fractions)", lambda: filtering("fractions")), ("Pairs of samples", pairs), ("Totals", totals), ("Knee plot", knee), ("Density", density), ("Session", session)]
    body = []
    for title, make in sections:
        try:
            content = make()
        except Exception as e:  # noqa: BLE001  a report shows what it can
            content = f"<p>not available: {html.escape(str(e)[:300])}</p>"
        body.append(f"<h2>{title}</h2>{content}")
    with open(outFile, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(reportTitle)}</title></head><body><h1>{html.escape(reportTitle)}</h1>{"".join(body)}</body></html>')
    return outFile
