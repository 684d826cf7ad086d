"""From reads to variant counts: one map over the reads, then independent aggregations of its outcome."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch
from ..sources.fastq import read_fastq, write_filtered
from ..spec import DigestSpec
from .cascade import CONST, COUNTS, TEXT, BatchDigester, cut, flat, spread
from .reads import FILTERS, LABELS, QUALITY_OFFSET, Digester
from .similarity import collapse_umis

log = logging.getLogger(__name__)

SQL_KIND = {c: "string" for c in (*TEXT, *CONST)} | {c: "int" for c in COUNTS} | {"types": "array<string>"}


def annotate(reads: DataFrame, spec: DigestSpec, keep: tuple[str, ...] = (), columns: tuple[str, ...] = (*TEXT, *COUNTS, "types", *CONST)) -> DataFrame:
    """The outcome of the cascade for each read (read_idx, seq1, qual1 and, for pairs, seq2, qual2), with columns to keep.
    Of the outcome, only the named columns leave the Python workers."""
    mates = ["seq1", "qual1", "seq2", "qual2"] if spec.paired else ["seq1", "qual1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digester = BatchDigester(spec)
        for b in batches:
            found = digester.read(*b.columns[1 : 1 + len(mates)])
            yield pa.RecordBatch.from_arrays([b.column(0), *(found[c] for c in columns), *b.columns[1 + len(mates) :]], ["read_idx", *columns, *keep])

    schema = "read_idx long" + "".join(f", {c} {SQL_KIND[c]}" for c in columns) + "".join(f", `{c}` {reads.schema[c].dataType.simpleString()}" for c in keep)
    return reads.select(F.col("read_idx").cast("long"), *mates, *keep).mapInArrow(run, schema)


def decompose(reads: DataFrame, spec: DigestSpec) -> DataFrame:
    """read_idx and the parts of each first mate: umi, var, const, lengths and the failure, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Digester(spec).cutters[0]
        names = pa.array(["", *FILTERS], pa.string())
        for b in batches:
            p = cut(cutter, b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), p.umi, p.var, p.const, p.lengths, names.take(pa.array(p.failure))], ["read_idx", "umi", "var", "const", "lengths", "failure"])

    return reads.select(F.col("read_idx").cast("long"), "seq1", "qual1").mapInArrow(run, "read_idx long, umi string, var string, const string, lengths string, failure string")


def merge_pairs(reads: DataFrame, **options) -> DataFrame:
    """read_idx, merged sequence, its length and whether there was a valid overlap, for whole mates (as in merge_pair)."""
    from .reads import merge_pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merge_pair(f, fq, r, rq, [len(f)], [len(r)], **options) for f, fq, r, rq in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] if m else None for m in found], pa.string()), pa.array([m[1] if m else None for m in found], pa.string()), pa.array([m is not None for m in found])], ["read_idx", "merged", "quality", "valid"])

    return reads.select(F.col("read_idx").cast("long"), "seq1", "qual1", "seq2", "qual2").mapInArrow(run, "read_idx long, merged string, quality string, valid boolean")


def nearest_reference(strings: DataFrame, refs: list[str], bound: int, index: bool = False) -> DataFrame:
    """id, idx: the reference with most matches within the bound; -1 none, -2 a tie (columns id, s). The references go to every
    task; an index of their blocks helps where there are thousands."""
    from .reads import ReferenceIndex, nearest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        find = ReferenceIndex(refs, bound).nearest if index else lambda t: nearest(t, refs, bound)
        for b in batches:
            texts = b.column(1).to_pylist()
            for t in set(texts) - known.keys():
                known[t] = find(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known[t] for t in texts], pa.int32())], ["id", "idx"])

    return strings.select(F.col("id").cast("long"), "s").mapInArrow(run, "id long, idx int")


def filter_summary(outcome: DataFrame) -> DataFrame:
    """One row: all reads, those that each filter took, and those retained."""
    counts = [F.count_if(F.col("failure") == f).alias(f) for f in FILTERS]
    return outcome.select("failure").agg(F.count("*").alias("nbrTotal"), *counts, F.count_if(F.col("failure") == "").alias("nbrRetained"))


def _set(c: str | Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def summary_table(outcome: DataFrame, umi_max_dist: float = 0) -> DataFrame:
    """A row per variant, in order of its name."""
    kept = outcome.where("failure = ''")
    texts = ("name", "umi", "sequence", "lengths", "base", "codon", "base_hgvs", "aa", "aa_hgvs", "sequence_aa", *COUNTS)
    # reads of one sequence and UMI are alike but for their number: they are counted in one pass over the reads and written,
    # and what follows reads that
    alike = kept.select("read_idx", *texts, F.array_join("types", ",").alias("types")).groupBy(*texts, "types").agg(F.count("*").alias("n"), F.min("read_idx").alias("first"))
    alike = scratch.cut(alike)
    one = alike.where("umi <> ''").select(F.col("name").alias("mutantName"), "umi").distinct()
    own = [c for c in (*texts, "types") if c != "umi"]
    table = alike.groupBy(*own).agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy(F.col("name").alias("mutantName")).agg(
        _set("sequence").alias("sequence"),
        F.sum("n").alias("nbrReads"),
        F.sum("n").alias("maxNbrReads"),
        *(F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",").alias(n) for c, n in zip(COUNTS, ("nbrMutBases", "nbrMutCodons", "nbrMutAAs"), strict=True)),
        F.min_by("lengths", "first").alias("varLengths"),
        *(_set(c).alias(n) for c, n in (("base", "mutantNameBase"), ("codon", "mutantNameCodon"), ("base_hgvs", "mutantNameBaseHGVS"), ("aa", "mutantNameAA"), ("aa_hgvs", "mutantNameAAHGVS"))),
        F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("types", ",")))), lambda x: x != "")), ",").alias("mutationTypes"),
        _set("sequence_aa").alias("sequenceAA"),
    )
    if umi_max_dist <= 0:  # distinct pairs are counted: a variant's UMIs never gather in one row
        umis = one.groupBy("mutantName").agg(F.count("*").alias("nbrUmis"))
    else:
        tolerance = int(umi_max_dist)
        if umi_max_dist < 1:  # a share of the length of the first UMI of the first variant
            first = one.agg(F.min(F.struct("mutantName", "umi")).alias("f")).collect()[0].f
            tolerance = int(umi_max_dist * len(first.umi)) if first else 0
        umis = collapse_umis(one, tolerance, ["mutantName"]).groupBy("mutantName").agg(F.count("*").alias("nbrUmis"))
    table = table.join(umis, "mutantName", "left").withColumn("nbrUmis", F.coalesce("nbrUmis", F.lit(0)).cast("long"))
    order = ["mutantName", "sequence", "nbrReads", "maxNbrReads", "nbrUmis", "nbrMutBases", "nbrMutCodons", "nbrMutAAs", "varLengths", "mutantNameBase", "mutantNameCodon", "mutantNameBaseHGVS", "mutantNameAA", "mutantNameAAHGVS", "mutationTypes", "sequenceAA"]
    return table.select(order).orderBy("mutantName")


def error_statistics(outcome: DataFrame) -> DataFrame:
    """For Phred qualities 0 to 99: matching and mismatching constant bases of retained reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, 100), np.int64)
        for b in batches:
            for side in (0, 1):
                (seq, s_at), (qual, q_at), (ref, r_at) = (flat(b.column(3 * side + i)) for i in range(3))
                n = np.minimum(np.diff(s_at), np.diff(r_at))
                if not n.any():
                    continue
                q = qual[spread(q_at[:-1], n)].astype(np.int64) - QUALITY_OFFSET
                if q.max() > 99 or q.min() < 0:
                    raise ValueError("a Phred quality is not within 0 .. 99")
                same = seq[spread(s_at[:-1], n)] == ref[spread(r_at[:-1], n)]
                counts[2 * side] += np.bincount(q[same], minlength=100)
                counts[2 * side + 1] += np.bincount(q[~same], minlength=100)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(100), pa.int32()), *(pa.array(c) for c in counts)], ["q", "a", "b", "c", "d"])

    parts = outcome.where("failure = ''").select(CONST).mapInArrow(run, "q int, a long, b long, c long, d long")
    names = ["nbrMatchForward", "nbrMismatchForward", "nbrMatchReverse", "nbrMismatchReverse"]
    sums = parts.groupBy("q").agg(*(F.sum(c).alias(n) for c, n in zip("abcd", names, strict=True)))
    all_ = outcome.sparkSession.range(100).select(F.col("id").cast("int").alias("PhredQuality"))
    return all_.join(sums, F.col("q") == F.col("PhredQuality"), "left").select("PhredQuality", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


@dataclass
class DigestResult:
    summaryTable: DataFrame
    filterSummary: DataFrame
    errorStatistics: DataFrame
    parameters: dict = field(default_factory=dict)
    outcome: DataFrame | None = None


def digest_reads(reads: DataFrame, spec: DigestSpec) -> DigestResult:
    """Digest a DataFrame of reads (read_idx, seq1, qual1[, seq2, qual2]). The outcome is kept for the three aggregations."""
    outcome = annotate(reads, spec).persist()
    stamp = f"Processed by mavelake on {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S}"
    return DigestResult(summary_table(outcome, spec.umiCollapseMaxDist), filter_summary(outcome), error_statistics(outcome), spec.parameters() | {"processingInfo": stamp}, outcome)


def filtered_reads(reads: DataFrame, outcome: DataFrame) -> DataFrame:
    """The raw reads that a filter took, with its label."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    lost = outcome.where("failure <> ''").select("read_idx", label[F.col("failure")].alias("label"))
    return reads.join(lost, "read_idx")


def digest_fastqs(spark: SparkSession, **arguments) -> DigestResult:
    """Digest FASTQ files; the arguments are those of DigestSpec. nThreads and chunkSize have no effect: Spark's partitions
    stand for both."""
    spec = DigestSpec.of(True, **arguments)
    reads = read_fastq(spark, spec.fastqForward, spec.fastqReverse or None, int(spec.maxNReads), int(spec.maxReadLength))
    result = digest_reads(reads, spec)
    if spec.filteredReadsFastqForward:
        write_filtered(filtered_reads(reads, result.outcome), spec.filteredReadsFastqForward, spec.filteredReadsFastqReverse or None)
    if spec.verbose:
        row = result.filterSummary.collect()[0]
        log.info("retained %d of %d reads (%.1f%%)", row.nbrRetained, row.nbrTotal, 100 * row.nbrRetained / max(1, row.nbrTotal))
    return result
