"""Linking several variable regions of a molecule: a star join of naive counts with a corrected table for each region."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fastq import read_fastq
from ..spec import DigestSpec
from .digest import DigestResult, digest_reads
from .similarity import group_similar_sequences

COLLAPSE = {"collapseMaxDist": "max_dist", "collapseMinScore": "min_score", "collapseMinRatio": "min_ratio"}


@dataclass
class LinkResult:
    countAggregated: DataFrame
    convSeparate: dict[str, DataFrame]
    outCombined: DigestResult
    filtSeparate: dict[str, DataFrame]


def split_regions(naive: DataFrame, names: list[str]) -> DataFrame:
    """nbrReads and a column per region, cut from the sequence by the lengths of its segments (both sides of a `_`)."""
    seq = F.split("sequence", "_", -1)
    sizes = F.transform(F.split("varLengths", "_", -1), lambda x: F.split(x, ",", -1))
    pieces = F.flatten(
        F.transform(
            F.arrays_zip(seq.alias("s"), sizes.alias("n")),
            lambda side: F.transform(side.n, lambda x, i: F.substring(side.s, F.aggregate(F.slice(side.n, 1, i), F.lit(0), lambda a, y: a + y.cast("int")) + 1, x.cast("int"))),
        )
    )
    cut = naive.select("nbrReads", pieces.alias("p"))
    checked = F.when(F.size("p") == len(names), F.col("p")).otherwise(F.raise_error(F.lit(f"each variable sequence must have {len(names)} segments")))
    return cut.select("nbrReads", checked.alias("p")).select("nbrReads", *(F.col("p")[i].alias(n) for i, n in enumerate(names)))


def conversion_table(summary: DataFrame) -> DataFrame:
    """(sequence, mutantName): the first name, in order, of each sequence."""
    return summary.select(F.explode(F.split("sequence", ",", -1)).alias("sequence"), "mutantName").groupBy("sequence").agg(F.min("mutantName").alias("mutantName"))


def link_tables(naive: DataFrame, conversions: dict[str, DataFrame]) -> DataFrame:
    """Counts by the corrected names of all regions; reads with a region that has none are dropped."""
    out = split_regions(naive, list(conversions))
    for n, table in conversions.items():
        out = out.join(table.select(F.col("sequence").alias(n), F.col("mutantName").alias(f"_{n}")), n).drop(n).withColumnRenamed(f"_{n}", n)
    return out.groupBy(*conversions).agg(F.sum("nbrReads").alias("nbrReads"))


def link_multiple_variants(spark: SparkSession, combinedDigestParams: dict, **separate: dict) -> LinkResult:
    """Digest all regions together as they are read, each region by itself as it is corrected, and link both.

    Runs that read the same files share one scan. Read counts are used throughout.
    """
    known = {f.name for f in fields(DigestSpec)}
    for params, extra in ((combinedDigestParams, set()), *((p, set(COLLAPSE)) for p in separate.values())):
        if not isinstance(params, dict):
            raise TypeError("digest parameters must be named lists")
        if unknown := set(params) - known - extra:
            raise ValueError(f"unknown digest parameters: {', '.join(sorted(unknown))}")
    specs = {}
    for n, p in separate.items():
        spec = DigestSpec.of(True, **{k: v for k, v in p.items() if k not in COLLAPSE})
        f, r = spec.elementsForward.count("V"), spec.elementsReverse.count("V")
        if not f and not r:
            raise ValueError("a separate run without a variable segment")
        if f and r and not spec.mergeForwardReverse:
            raise ValueError("a separate run whose mates both have variable segments must merge them")
        if f > 1 or r > 1:
            raise ValueError("a separate run with several variable segments in one mate")
        if 0 < sum(k in p for k in COLLAPSE) < 3:
            raise ValueError("collapseMaxDist, collapseMinScore and collapseMinRatio must be given together")
        specs[n] = spec
    combined = DigestSpec.of(True, **combinedDigestParams)
    if combined.has_component("U"):
        warnings.warn("UMIs can't be added up across regions: reads are counted", stacklevel=2)
    scans: dict[tuple, DataFrame] = {}

    def reads(spec: DigestSpec) -> DataFrame:
        key = (tuple(spec.fastqForward), tuple(spec.fastqReverse), spec.maxNReads, spec.maxReadLength)
        if key not in scans:
            scans[key] = read_fastq(spark, spec.fastqForward, spec.fastqReverse or None, int(spec.maxNReads), int(spec.maxReadLength)).persist()
        return scans[key]

    out = digest_reads(reads(combined), combined)
    conversions, filters = {}, {}
    for n, spec in specs.items():
        one = digest_reads(reads(spec), spec)
        filters[n] = one.filterSummary
        if any(k in separate[n] for k in COLLAPSE):
            groups = group_similar_sequences(one.summaryTable.withColumnRenamed("nbrReads", "score"), **{v: separate[n][k] for k, v in COLLAPSE.items()})
            conversions[n] = groups.toDF("sequence", "mutantName")
        else:
            conversions[n] = conversion_table(one.summaryTable)
    return LinkResult(link_tables(out.summaryTable, conversions), conversions, out, filters)


