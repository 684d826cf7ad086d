"""The per-read stage on a stream. It has no state, so it runs on streams as on tables; running counts per variant and per
filter are kept by Structured Streaming. What needs a bounded input (limits, UMI collapsing, first segment lengths) stays
with the batch digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.digest import annotate
from ..spec import DigestSpec


def variant_counts(reads: DataFrame, spec: DigestSpec) -> DataFrame:
    """Running (mutantName, nbrReads, approxUmis); the number of UMIs is estimated so that state stays bounded."""
    kept = annotate(reads, spec).where("failure = ''")
    return kept.groupBy(F.col("name").alias("mutantName")).agg(F.count("*").alias("nbrReads"), F.approx_count_distinct(F.when(F.col("umi") != "", F.col("umi"))).alias("approxUmis"))


def filter_counts(reads: DataFrame, spec: DigestSpec) -> DataFrame:
    """Running number of reads that each filter took ('' for retained ones)."""
    return annotate(reads, spec).groupBy("failure").agg(F.count("*").alias("nbrReads"))
