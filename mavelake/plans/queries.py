"""The queries over the benchmark tables and their SQL.

The tables hold no reads, so reads are derived from `lineitem` by integer arithmetic and MD5 alone; the same SELECT text
gives them to Spark and to the SQL side.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genetics as g
from ..operators import digest, dispersion, experiment, link, qc, similarity, stats
from ..operators.density import pair_density as _pair_density
from ..operators.metric_index import MetricIndex
from ..operators.reads import FILTERS, LABELS
from ..operators.trend import local_trend
from ..sources.fastq import read_fastq
from ..spec import DigestSpec
from . import scratch

#: A reference of 32 codons, a constant part and an adapter of our own.
WILD = "ATGGCTAAGGATTTCCGTCAGGAACTGTACCATGGCAACATCTGGGTTAGCCCGACCTGCAAAGAGCGTTTGGCAGATCACTACAATGTCTCAGGC"
CONST = "GATTCCAGGCTTAGCCAT"
ADAPTER = "GGTTGGCCAATTGGCC"
DNA = "translate(md5(cast({} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"

READS = f"""
SELECT k, rf, ls, seq1, repeat(chr(cast(33 + CASE WHEN k % 29 = 0 THEN 10 ELSE 30 + k % 10 END AS int)), cast(length(seq1) AS int)) AS qual1
FROM (SELECT k, rf, ls, CASE WHEN k % 43 = 0 THEN substr(s, 1, 120) WHEN k % 41 = 0 THEN substr(s, 1, 100) || '{ADAPTER}' || substr(s, 117) ELSE s END AS seq1
FROM (SELECT k, rf, ls, 'A' || umi || CASE WHEN k % 23 = 0 THEN substr('{CONST}', 1, 4) || 'G' || substr('{CONST}', 6) ELSE '{CONST}' END
  || CASE WHEN k % 37 = 0 THEN substr(v, 1, 10) || 'N' || substr(v, 12) ELSE v END AS s
FROM (SELECT k, rf, ls, umi, CASE WHEN k % 5 = 0 THEN substr(v1, 1, cast(q AS int)) || b2 || substr(v1, cast(q + 2 AS int)) ELSE v1 END AS v
FROM (SELECT k, rf, ls, umi, q, b2, substr('{WILD}', 1, cast(p AS int)) || b || substr('{WILD}', cast(p + 2 AS int)) AS v1
FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_returnflag AS rf, l_linestatus AS ls, l_partkey % 96 AS p, l_orderkey % 96 AS q,
  substr('ACGT', cast(l_suppkey % 4 + 1 AS int), 1) AS b, substr('ACGT', cast(l_linenumber % 4 + 1 AS int), 1) AS b2,
  substr({DNA.format("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)")}, 1, 10) AS umi FROM {{lineitem}}) a) b) c) d) e
"""
SPEC = dict(elementsForward="SUCV", elementLengthsForward=[1, 10, 18, 96], adapterForward=ADAPTER, wildTypeForward=WILD, constantForward=CONST, forbiddenMutatedCodonsForward="NNW")
#: Two references and three constants of our own for reads that meet every filter.
SHORT, SHORT_CONST = ["ACGACGTTGCAA", "ACGACGTTGCTT"], ["GATTCC", "GATACC", "CCTGAA"]
_ACGT, _POSITIONS = "(VALUES ('A'), ('C'), ('G'), ('T'))", "(VALUES " + ", ".join(f"({i})" for i in range(24)) + ")"
_PUT = "substr({0}, 1, cast({1} AS int)) || {2} || substr({0}, cast({1} AS int) + 2)"
REFERENCES = f"SELECT DISTINCT {_PUT.format('r', 'i', 'b')} AS r FROM (SELECT substr({DNA.format('n_nationkey')}, 1, 24) AS r FROM {{nation}}) n CROSS JOIN {_ACGT} x(b) CROSS JOIN {_POSITIONS} y(i)"
CHANGED = f"""SELECT k AS id, {_PUT.format('s', 'k % 7', "'C'")} AS s FROM (SELECT k, {_PUT.format('s', 'k % 24', "'A'")} AS s FROM (
  SELECT c_custkey AS k, {_PUT.format(f"substr({DNA.format('c_nationkey')}, 1, 24)", 'c_custkey % 23', "'G'")} AS s FROM {{customer}}) a) b"""
MATES_OF_ORDERS = [f"{DNA.format('o_orderkey')} AS seq1", f"substr({DNA.format('o_custkey')}, 1, cast(1 + o_orderkey % 31 AS int)) AS seq2"]
_KEY = "l_orderkey * 10 + l_linenumber AS k"
_UMI = DNA.format("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)")
_BASE = "substr('ACGT', cast(l_suppkey % 4 + 1 AS int), 1) AS b"
SHORT_READS = f"""
SELECT k, CASE WHEN k % 43 = 0 THEN substr(s, 1, 20) WHEN k % 41 = 0 THEN 'GGTTGGCC' || substr(s, 9) ELSE s END AS seq1, repeat(chr(cast(33 + CASE WHEN k % 29 = 0 THEN 10 ELSE 22 + k % 10 END AS int)), cast(CASE WHEN k % 43 = 0 THEN 20 ELSE 22 END AS int)) AS qual1
FROM (SELECT k, CASE WHEN k % 19 = 0 THEN 'N' || substr(u, 2) ELSE u END || CASE WHEN k % 11 = 0 THEN 'GATGCC' WHEN k % 13 = 0 THEN 'TTGTCC' WHEN k % 2 = 0 THEN 'GATACC' ELSE 'GATTCC' END
  || CASE WHEN k % 37 = 0 THEN 'NCGACGTTGCAA' WHEN k % 17 = 0 THEN 'ACGACGTTGCAT' WHEN k % 7 = 0 THEN 'TTTTTTTTTTTT' ELSE substr(r, 1, cast(p AS int)) || b || substr(r, cast(p + 2 AS int)) END AS s
FROM (SELECT {_KEY}, l_partkey % 12 AS p, {_BASE}, substr({_UMI}, 1, 4) AS u, CASE WHEN l_suppkey % 3 = 0 THEN '{SHORT[1]}' ELSE '{SHORT[0]}' END AS r FROM {{lineitem}}) x) y
"""
PAIRS = f"""
SELECT k, substr(u, 1, 6) || substr('{WILD[:48]}', 1, cast(p AS int)) || b || substr('{WILD[:48]}', cast(p + 2 AS int)) AS seq1, repeat('I', 54) AS qual1,
  substr(u, 7, 4) || substr('{WILD[48:]}', 1, cast(q AS int)) || b || substr('{WILD[48:]}', cast(q + 2 AS int)) AS seq2, repeat('I', 52) AS qual2
FROM (SELECT {_KEY}, l_partkey % 48 AS p, l_orderkey % 48 AS q, {_BASE}, {_UMI} AS u FROM {{lineitem}}) x
"""
MATES = f"""
SELECT k, substr(m, 1, 60) AS seq1, repeat('I', 60) AS qual1, reverse(translate(CASE WHEN k % 7 = 0 THEN translate(substr(m, 37), 'ACGT', 'CATG') ELSE substr(m, 37) END, 'ACGT', 'TGCA')) AS seq2, repeat('I', 60) AS qual2
FROM (SELECT k, substr('{WILD}', 1, cast(p AS int)) || b || substr('{WILD}', cast(p + 2 AS int)) AS m FROM (SELECT {_KEY}, l_partkey % 96 AS p, {_BASE} FROM {{lineitem}}) x) y
"""


@lru_cache(None)
def spec() -> DigestSpec:
    return DigestSpec.of(**SPEC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READS, lineitem=table(spark, sf_dir, "lineitem")).withColumnRenamed("k", "read_idx")


def strings(spark: SparkSession, sf_dir: str, name: str, key: str, n: int) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(f"{key} AS id", f"substr({DNA.format(key)}, 1, {n}) AS s")


def outcome(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return digest.annotate(reads(spark, sf_dir), spec(), **({"columns": columns} if columns else {}))


def distances(spark, sf):
    a = table(spark, sf, "part").selectExpr("p_partkey AS id", f"substr({DNA.format('p_partkey')}, 1, 12) AS a", f"substr({DNA.format('p_partkey + 1')}, 1, 12) AS b")
    ca, cb = F.col("a"), F.col("b")
    return a.select("id", g.hamming(ca, cb).cast("long").alias("hamming"), g.hamming_shift(ca, cb).cast("long").alias("hamming_shift"), g.hamming_shift(ca, cb, 2).cast("long").alias("hamming_shift2"), F.levenshtein(ca, cb).cast("long").alias("levenshtein"))


def sequence_functions(spark, sf):
    s = strings(spark, sf, "part", "p_partkey", 31)
    c = F.col("s")
    return s.select("id", g.reverse_complement(c).alias("revcomp"), g.translate(c).alias("protein"), g.count_n(F.translate(c, "A", "N")).cast("long").alias("n_count"), F.round(g.mean_quality(c), 6).alias("mean_quality"))


def decompose_sucv(spark, sf):
    return digest.decompose(reads(spark, sf), spec()).drop("read_idx").groupBy("umi", "var", "const", "lengths", "failure").agg(F.count("*").alias("n"))


def decompose_infer(spark, sf):
    s = DigestSpec.of(elementsForward="SUCV", elementLengthsForward=[1, 10, 18, -1])
    return digest.decompose(reads(spark, sf), s).groupBy("umi", "var", "lengths").agg(F.count("*").alias("n"))


def decompose_primer(spark, sf):
    s = DigestSpec.of(elementsForward="SUPV", elementLengthsForward=[1, 10, -1, -1], primerForward=[CONST, "AAAAAA"])
    return digest.decompose(reads(spark, sf), s).groupBy("umi", "var", "lengths", "failure").agg(F.count("*").alias("n"))


def filter_summary(spark, sf):
    return digest.filter_summary(outcome(spark, sf, "failure"))


def digest_summary(spark, sf):
    return digest.summary_table(outcome(spark, sf))


def error_statistics(spark, sf):
    return digest.error_statistics(outcome(spark, sf, "failure", *digest.CONST))


def variant_names(spark, sf):
    """Names of all distinct variable parts by JVM expressions alone."""
    v = reads(spark, sf).where(F.length("seq1") == 125).select(F.substring("seq1", 30, 96).alias("var")).where("var NOT LIKE '%N%'").distinct()
    var, ref = F.col("var"), F.lit(WILD)
    v = v.select("var", g.mismatches(var, ref).alias("d"), g.mutated_codons(var, ref).alias("c"))
    bases = F.transform("d", lambda x: F.struct((x.i + 1).alias("p"), x.v.alias("v")))
    v = v.withColumn("a", g.aa_changes(F.col("c")))
    return v.select("var", g.variant_name(bases, "f").alias("name_base"), g.variant_name(F.col("c"), "f").alias("name_codon"), g.variant_name(F.col("a"), "f").alias("name_aa"), g.base_hgvs(F.col("d"), var, "f").alias("hgvs_base"), g.aa_hgvs(F.col("a"), "f").alias("hgvs_aa"), g.mutation_types(F.col("c")).alias("types"))


def filtered_reads(spark, sf):
    """As several reads can share a key, each is joined by the key and its number among them; the result has the key."""
    number = F.row_number().over(Window.partitionBy("k").orderBy("seq1", "qual1"))
    r = reads(spark, sf).withColumnRenamed("read_idx", "k").select("k", F.shiftleft(F.col("k").cast("long"), 20).bitwiseOR(number.cast("long")).alias("read_idx"), "seq1", "qual1")
    return digest.filtered_reads(r, digest.annotate(r, spec())).select(F.col("k").alias("read_idx"), "label", "seq1")


def _fastq(rows: DataFrame, *mates: str, compression: str = "gzip") -> list[list[str]]:
    """Write reads (columns seq1, qual1, seq2, qual2) as FASTQ files to the shared folder; the files of each mate in order."""
    out = []
    for m in mates:
        path = scratch.path(rows.sparkSession)
        text = F.concat(F.lit("@r\n"), F.col(f"seq{m}"), F.lit("\n+\n"), F.col(f"qual{m}"))
        rows.select(text.alias("value")).write.option("compression", compression).text(path)
        out.append(scratch.files(rows.sparkSession, path, ".gz" if compression == "gzip" else ".txt"))
    return out


def limit_reads(spark, sf):
    """The first 1000 reads of FASTQ files in their order: maxNReads of the digest."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS k", f"{DNA.format('o_orderkey')} AS seq1", "repeat('I', 32) AS qual1")
    return read_fastq(spark, _fastq(o.orderBy("k"), "1")[0], max_n_reads=1000).select("read_idx", "seq1")


def fastq_mates(spark, sf):
    """Pairs from plain FASTQ files of which several tasks read each: ranges of 64 KB, that aren't at the same record in both."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS k", *MATES_OF_ORDERS).selectExpr("k", "seq1", "repeat('@', length(seq1)) AS qual1", "seq2", "repeat('+', length(seq2)) AS qual2")
    ordered = o.orderBy("k").persist()  # both mates have the same files
    files = _fastq(ordered, "1", "2", compression="none")
    ordered.unpersist()
    return read_fastq(spark, *files, split_bytes=1 << 16).select("read_idx", "seq1", "seq2", F.length("qual1").alias("n_qual1"), F.length("qual2").alias("n_qual2"))


def fastq_filter_summary(spark, sf):
    """From FASTQ files to counters."""
    return digest.digest_fastqs(spark, fastqForward=_fastq(reads(spark, sf), "1")[0], **SPEC).filterSummary


def umi_collapse(spark, sf):
    """The kept UMIs of each variant of the digest, where those within three mismatches count once."""
    u = outcome(spark, sf, "failure", "name", "umi").where("failure = ''").select(F.col("name").alias("mutantName"), "umi").distinct()
    kept = similarity.collapse_umis(u, 3, ["mutantName"])
    return kept.groupBy("mutantName").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("umi")), ",").alias("kept"))


def _outcomes(rows: DataFrame, s: DigestSpec) -> DataFrame:
    """Reads and distinct UMIs by the filter that takes them and the variant's name."""
    out = digest.annotate(rows, s, columns=("failure", "name", "umi", "lengths"))
    return out.groupBy("failure", "name", "lengths").agg(F.count("*").alias("n"), F.count_distinct("umi").alias("n_umis"))


def filter_outcomes(spark, sf):
    """Short reads of which every filter of single reads takes some: two references, three constants, bases counted."""
    s = DigestSpec.of(elementsForward="UCV", elementLengthsForward=[4, 6, 12], adapterForward="GGTTGGCC", wildTypeForward=dict(zip("ab", SHORT, strict=True)), constantForward=SHORT_CONST, nbrMutatedCodonsMaxForward=-1, nbrMutatedBasesMaxForward=2, forbiddenMutatedCodonsForward="NNW", mutatedPhredMinForward=25, constantMaxDistForward=1)
    return _outcomes(spark.sql(SHORT_READS, lineitem=table(spark, sf, "lineitem")).withColumnRenamed("k", "read_idx"), s)


def paired_outcomes(spark, sf):
    """Pairs that stay apart: a reference and an UMI in each mate."""
    s = DigestSpec.of(elementsForward="UV", elementLengthsForward=[6, 48], elementsReverse="UV", elementLengthsReverse=[4, 48], wildTypeForward={"f": WILD[:48]}, wildTypeReverse={"r": WILD[48:]}, fastqForward="f", fastqReverse="r")
    return _outcomes(spark.sql(PAIRS, lineitem=table(spark, sf, "lineitem")).withColumnRenamed("k", "read_idx"), s)


def merged_outcomes(spark, sf):
    """Pairs merged by an overlap of 24 bases, which some of them lack."""
    s = DigestSpec.of(elementsForward="V", elementLengthsForward=[60], elementsReverse="V", elementLengthsReverse=[60], mergeForwardReverse=True, revComplReverse=True, minOverlap=24, maxOverlap=24, maxFracMismatchOverlap=0, wildTypeForward={"f": WILD}, fastqForward="f", fastqReverse="r")
    return _outcomes(spark.sql(MATES, lineitem=table(spark, sf, "lineitem")).withColumnRenamed("k", "read_idx"), s)


def similarity_groups(spark, sf):
    p = strings(spark, sf, "part", "p_partkey", 8).groupBy(F.col("s").alias("sequence")).agg(F.count("*").cast("double").alias("score"))
    return similarity.group_similar_sequences(p, 1, 0, 1)


def _variant_scores(spark, sf) -> DataFrame:
    """The distinct variable parts of the retained reads, all made from one sequence, with their numbers of reads."""
    o = outcome(spark, sf, "failure", "sequence").where("failure = ''")
    return o.groupBy("sequence").agg(F.count("*").cast("double").alias("score"))


def similarity_groups_variants(spark, sf):
    """Groups of the digest's own sequences within two bases, of at least 1.5 times the reads of those they take."""
    return similarity.group_similar_sequences(_variant_scores(spark, sf), 2, 3, 1.5)


def variant_neighbours(spark, sf):
    """How many sequences of the digest are one and two bases away from each."""
    v = scratch.cut(_variant_scores(spark, sf).select(F.col("sequence").alias("s")))
    near = similarity.hamming_pairs(v, v, 2, WILD).where("a <> b").groupBy(F.col("a").alias("sequence"))
    return near.agg(F.count_if(F.col("dist") == 1).alias("n_1"), F.count_if(F.col("dist") == 2).alias("n_2"))


def nearest_string_dist(spark, sf):
    return similarity.nearest_string_dist(strings(spark, sf, "supplier", "s_suppkey", 12))


def nearest_by_edits(spark, sf):
    """The nearest other string by edit distance and by mismatches with shifts."""
    s = strings(spark, sf, "supplier", "s_suppkey", 12)
    one, two = (similarity.nearest_string_dist(s, m).withColumnRenamed("dist", m) for m in ("levenshtein", "hamming_shift"))
    return one.join(two, "id")


def similarity_search(spark, sf):
    return similarity.similarity_search(strings(spark, sf, "part", "p_partkey", 12), strings(spark, sf, "supplier", "s_suppkey", 12), 3)


def index_updates(spark, sf):
    """An index of all parts' sequences, from which customers' are removed and to which suppliers' are added; searched for the
    sequences that were removed, by mismatches and by edits."""
    names = [("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")]
    parts, customers, suppliers = (strings(spark, sf, t, k, 10) for t, k in names)
    found = []
    for metric in ("hamming", "levenshtein"):
        index = MetricIndex.build(spark, parts, metric, 2).remove(customers).insert(suppliers)
        near = index.search(customers, 2).join(index.all().withColumnRenamed("s", "match"), "match")
        found.append(near.select(F.lit(metric).alias("metric"), "query", "match", F.col("dist").cast("long").alias("dist"), F.col("at").alias("place")))
    return found[0].union(found[1])


def nearest_reference(spark, sf):
    refs = [r.s for r in strings(spark, sf, "nation", "n_nationkey", 12).orderBy("id").collect()]  # 25 rows
    return digest.nearest_reference(strings(spark, sf, "part", "p_partkey", 12), refs, 8)


def indexed_reference(spark, sf):
    """Sequences of customers, up to three bases from their nation's, against all variants of one base of the 25 nations' sequences."""
    refs = [r.r for r in spark.sql(REFERENCES, nation=table(spark, sf, "nation")).orderBy("r").collect()]  # at most 25 * 73
    return digest.nearest_reference(spark.sql(CHANGED, customer=table(spark, sf, "customer")), refs, 1, index=True)


def merge_pairs(spark, sf):
    """Mates cut from one molecule of 32 bases with an overlap of 12."""
    m = table(spark, sf, "part").selectExpr("p_partkey AS read_idx", f"{DNA.format('p_partkey')} AS m").selectExpr("read_idx", "substr(m, 1, 22) AS seq1", "repeat('I', 22) AS qual1", "substr(m, 11) AS seq2", "repeat('I', 22) AS qual2")
    return digest.merge_pairs(m, min_overlap=12, max_overlap=12, max_frac=0.0).select("read_idx", "merged", "valid")


def merge_values(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("cast(l_suppkey AS bigint) AS name", "concat_ws(',', l_returnflag, '', l_linestatus) AS v")
    return experiment.merge_values(v, "name", "v")


def _experiment(spark, sf, count_type: str = "reads") -> experiment.Experiment:
    r = reads(spark, sf).withColumn("sample", F.concat_ws("_", "rf", "ls"))
    out = digest.annotate(r, spec(), ("sample",))
    cols = pd.DataFrame([{"Name": f"{a}_{b}", "Condition": a, "Replicate": b, "OD": 0.5 + 0.25 * i + 0.1 * j} for i, a in enumerate("ANR") for j, b in enumerate("FO")])
    return experiment.experiment_from_outcome(out, "sample", cols, count_type)


def summarize_experiment(spark, sf):
    return _experiment(spark, sf, "umis").assays.select("mutantName", "sample", F.col("value").cast("long").alias("value"))


def variant_annotations(spark, sf):
    return _experiment(spark, sf).row_data.select("mutantName", "sequence", "nbrMutBases", F.col("minNbrMutBases").cast("long").alias("minNbrMutBases"), F.col("maxNbrMutAAs").cast("long").alias("maxNbrMutAAs"), "mutantNameAA", "mutationTypes")


def collapse_aa(spark, sf):
    se = experiment.collapse_mutants_by_aa(_experiment(spark, sf))
    return se.assays.select("mutantName", "sample", F.col("value").cast("long").alias("value"))


def relabel(spark, sf):
    names = _experiment(spark, sf).row_data.select("mutantName")
    conv = spark.range(0, 33, 3).select(F.lit("f").alias("seqname"), F.col("id").cast("string").alias("position"), F.concat(F.lit("p"), (F.col("id") + 100).cast("string")).alias("name"))
    return experiment.relabel_names(names, conv)


def summarize_samples(spark, sf):
    """Each sample digested by itself, then combined; one sample has no annotation and is left out."""
    r = reads(spark, sf).withColumn("sample", F.concat_ws("_", "rf", "ls"))
    one = {n: digest.digest_reads(r.where(F.col("sample") == n), spec()) for n in ("A_F", "N_O", "R_F")}
    cols = pd.DataFrame({"Name": ["R_F", "A_F"], "Condition": ["r", "a"]})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        se = experiment.summarize_experiment(one, cols, "umis")
    return se.assays.select("mutantName", "sample", F.col("value").cast("long").alias("value"))


def totals(spark, sf):
    return qc.plot_totals(_experiment(spark, sf)).select("sample", F.col("total").cast("long").alias("total"))


def knee(spark, sf):
    return experiment.knee_ranks(_experiment(spark, sf).assay()).select("mutantName", "sample", F.col("value").cast("long").alias("value"), F.col("idx").cast("long").alias("idx"))


def _sample_filters(spark, sf) -> DataFrame:
    r = reads(spark, sf).withColumn("sample", F.concat_ws("_", "rf", "ls"))
    out = digest.annotate(r, spec(), ("sample",), ("failure",))
    return out.groupBy(F.col("sample").alias("Name")).agg(F.count("*").alias("nbrTotal"), *(F.count_if(F.col("failure") == f).alias(f) for f in FILTERS), F.count_if(F.col("failure") == "").alias("nbrRetained"))


def filter_waterfall(spark, sf):
    return qc.filtering_frame(_sample_filters(spark, sf)).select("sample", "step", F.col("step_idx").cast("long").alias("step_idx"), "nbrReads", F.col("fracReads").cast("double").alias("fracReads"), "cumulNbr")


def _wide(spark, sf) -> tuple[DataFrame, list[str]]:
    se = _experiment(spark, sf)
    return se.dense(), se.samples


def pairs_correlation(spark, sf):
    wide, samples = _wide(spark, sf)
    logs = wide.select("mutantName", *(F.log10(F.col(s) + 1).alias(s) for s in samples))
    return qc.correlations(logs, samples).select("sample1", "sample2", F.round("cor", 6).alias("cor"))


def pairs_spearman(spark, sf):
    wide, samples = _wide(spark, sf)
    return qc.correlations(wide, samples, "spearman").select("sample1", "sample2", F.round("cor", 6).alias("cor"))


def pair_density(spark, sf):
    """The two-dimensional density of each pair of samples' log counts on 25 by 25 points."""
    wide, samples = _wide(spark, sf)
    logs = wide.select("mutantName", *(F.log10(F.col(s) + 1).alias(s) for s in samples))
    return _pair_density(logs, samples, 25).select("sample1", "sample2", *(F.round(c, 6).alias(c) for c in ("x", "y", "density")))


def count_histogram(spark, sf):
    wide, samples = _wide(spark, sf)
    long = wide.unpivot("mutantName", samples, "sample", "v").select("sample", F.log10(F.col("v") + 1).alias("x"))
    return qc.histogram_frame(long, 10, 0.0, 5.0).select("sample", F.col("bin").cast("long").alias("bin"), "n")


def fitness_score(spark, sf):
    se = _experiment(spark, sf)
    cols = spark.createDataFrame(se.col_data)
    f = stats.fitness_frame(se.assay(), cols, "Replicate", "Condition", ["A", "R"], ["OD"], se.row_data, ["f.0.WT"])
    return f.select("mutantName", F.col("pair").alias("replicate"), F.round("fitness", 6).alias("fitness"))


def wt_offsets(spark, sf):
    wide, samples = _wide(spark, sf)
    wide = scratch.cut(wide)
    names = [r.mutantName for r in wide.where("mutantName LIKE 'f.1.%' OR mutantName = 'f.0.WT'").select("mutantName").collect()]  # of one codon
    by = {n: stats.offsets(wide, samples, n, names) for n in ("sum", "geomean")}
    rows = [(s, round(float(a), 6), round(float(b), 6)) for s, a, b in zip(samples, by["sum"], by["geomean"], strict=True)]
    return spark.createDataFrame(rows, "sample string, log_sum double, log_geomean double")


def tmm(spark, sf):
    """Log effective library sizes by trimmed means of log ratios."""
    wide, samples = _wide(spark, sf)
    f = stats.tmm_factors(scratch.cut(wide), samples)
    return f.select("sample", F.round(F.log("library") + F.col("log_factor") - F.avg("log_factor").over(Window.partitionBy()), 6).alias("log_library"))  # a row per sample


def abundance_trends(spark, sf):
    """Each sample's log deviation from a variant's mean, as a robust local regression on that mean."""
    wide, samples = _wide(spark, sf)
    logs = [F.log(F.col(s) + 0.5) for s in samples]
    mean = F.round(sum(logs[1:], logs[0]) / len(samples), 9)  # equal means are equal, in whatever order they are added up
    rows = wide.select(mean.alias("x"), *((v - mean).alias(s) for v, s in zip(logs, samples, strict=True)))
    t = local_trend(rows, samples)
    found = [(s, round(float(x), 6), round(float(y[i]), 6)) for x, y in zip(t.x, t.y, strict=True) for i, s in enumerate(samples)]  # of 200 anchors
    return spark.createDataFrame(found, "sample string, abundance double, deviation double")


def dispersions(spark, sf):
    """Each variant's trended and own dispersion over six samples."""
    se = _experiment(spark, sf)
    design = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 0], [1, 0, 1], [1, 0, 1]], float)
    counts = scratch.cut(se.dense())
    return dispersion.estimate(counts, se.samples, design, stats.tmm(counts, se.samples))[2]


def bh_adjust(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "((p_partkey * 7919) % 10007 + 1) / 20000.0D AS p")
    return stats.adjust_bh(p, "p", "padj").select("id", F.round("padj", 9).alias("padj"))


def volcano_points(spark, sf):
    r = table(spark, sf, "part").selectExpr("cast(p_partkey AS string) AS mutantName", "((p_partkey * 31) % 200 - 100) / 25.0D AS logFC", "((p_partkey * 7919) % 10007 + 1) / 20000.0D AS PValue", "((p_partkey * 7919) % 10007 + 1) / 10008.0D AS FDR")
    return qc.plot_volcano(r, 0.05, nTopToLabel=10).select("mutantName", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "significant", "labelled")


def link_variants(spark, sf):
    """Two regions of 48 bases each; a region is corrected by its codon name where it has at most one mutated codon."""
    naive = digest.summary_table(outcome(spark, sf)).select(F.col("sequence"), "nbrReads", F.lit("48,48").alias("varLengths"))
    naive = scratch.cut(naive.select(F.explode(F.split("sequence", ",")).alias("sequence"), "nbrReads", "varLengths"))
    tables = {}
    for i, n in enumerate(("V1", "V2")):
        ref = WILD[48 * i : 48 * i + 48]
        own = naive.select(F.substring("sequence", 48 * i + 1, 48).alias("sequence")).distinct()
        tables[n] = own.select("sequence", g.variant_name(g.mutated_codons(F.col("sequence"), F.lit(ref)), n.lower()).alias("mutantName"))
    return link.link_tables(naive, tables)


def voom_limma(spark, sf):
    se = _experiment(spark, sf)
    design = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 0], [1, 0, 1], [1, 0, 1]], float)
    return stats.calculate_relative_fc(se, design, coef=2, method="limma")


def ql_test(spark, sf):
    se = _experiment(spark, sf)
    design = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 0], [1, 0, 1], [1, 0, 1]], float)
    return stats.calculate_relative_fc(se, design, coef=2, method="edgeR")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (digest_summary, filter_summary, error_statistics, variant_names, distances, sequence_functions, decompose_sucv, decompose_infer, decompose_primer, filtered_reads, limit_reads, fastq_mates, fastq_filter_summary, filter_outcomes, paired_outcomes, merged_outcomes, umi_collapse, similarity_groups, similarity_groups_variants, variant_neighbours, nearest_string_dist, nearest_by_edits, similarity_search, index_updates, nearest_reference, indexed_reference, merge_pairs, merge_values, summarize_experiment, summarize_samples, variant_annotations, collapse_aa, relabel, totals, knee, filter_waterfall, pairs_correlation, pairs_spearman, pair_density, count_histogram, fitness_score, wt_offsets, tmm, abundance_trends, dispersions, bh_adjust, volcano_points, link_variants, voom_limma, ql_test)}

# ---- SQL ----
R = READS.replace("{lineitem}", "lineitem")
_CODE = ", ".join(f"('{c}', '{a}')" for c, a in g.CODE.items())
_THREE = ", ".join(f"('{a}', '{t}')" for a, t in g.THREE.items())
#: Every read with the filter that takes it and, per variant, its mutated codons.
ANN = f"""
WITH code(c, aa) AS (VALUES {_CODE}), three(aa, t) AS (VALUES {_THREE}), r AS ({R}),
cut AS (SELECT k, rf, ls, seq1, qual1, ascii(substr(qual1, 1, 1)) - 33 AS q, length(seq1) AS n, substr(seq1, 2, 10) AS umi, substr(seq1, 12, 18) AS const, substr(seq1, 30) AS var FROM r),
vars AS (SELECT DISTINCT var FROM cut WHERE n = 125),
pos AS (SELECT unnest(range(32)) AS i), bpos AS (SELECT unnest(range(96)) AS i),
cod AS (SELECT var, i + 1 AS p, substr(var, 3 * i + 1, 3) AS v, substr('{WILD}', 3 * i + 1, 3) AS w FROM vars, pos WHERE substr(var, 3 * i + 1, 3) <> substr('{WILD}', 3 * i + 1, 3)),
codaa AS (SELECT cod.*, coalesce(a.aa, 'X') AS va, b.aa AS wa FROM cod LEFT JOIN code a ON a.c = v JOIN code b ON b.c = w),
bas AS (SELECT var, i + 1 AS p, substr(var, i + 1, 1) AS v, substr('{WILD}', i + 1, 1) AS w FROM vars, bpos WHERE substr(var, i + 1, 1) <> substr('{WILD}', i + 1, 1)),
c1 AS (SELECT var, count(*) AS nc, bool_or(substr(v, 3, 1) IN ('A', 'T')) AS forbidden, string_agg('f.' || p || '.' || v, '_' ORDER BY p) AS codon,
  count(*) FILTER (va <> wa) AS na, string_agg('f.' || p || '.' || va, '_' ORDER BY p) FILTER (va <> wa) AS aa,
  string_agg(DISTINCT CASE WHEN va = wa THEN 'silent' WHEN va = '*' THEN 'stop' ELSE 'nonsynonymous' END, ',' ORDER BY CASE WHEN va = wa THEN 'silent' WHEN va = '*' THEN 'stop' ELSE 'nonsynonymous' END) AS types FROM codaa GROUP BY var),
b1 AS (SELECT var, count(*) AS nb, string_agg('f.' || p || '.' || v, '_' ORDER BY p) AS base FROM bas GROUP BY var),
prot AS (SELECT var, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM (SELECT var, i, substr(var, 3 * i + 1, 3) AS c FROM vars, pos) JOIN code USING (c) GROUP BY var),
info AS (SELECT vars.var, coalesce(nb, 0) AS nb, coalesce(nc, 0) AS nc, coalesce(na, 0) AS na, coalesce(forbidden, false) AS forbidden, coalesce(codon, 'f.0.WT') AS codon, coalesce(base, 'f.0.WT') AS base, coalesce(aa, 'f.0.WT') AS aa, coalesce(types, '') AS types FROM vars LEFT JOIN c1 USING (var) LEFT JOIN b1 USING (var)),
ann AS (SELECT cut.*, info.* EXCLUDE (var), CASE WHEN instr(seq1, '{ADAPTER}') > 0 THEN 'f1_nbrAdapter' WHEN n <> 125 THEN 'f3_nbrReadWrongLength' WHEN q < 20 THEN 'f5_nbrAvgVarQualTooLow'
  WHEN contains(cut.var, 'N') THEN 'f6_nbrTooManyNinVar' WHEN nb > 3 OR nc > 1 THEN 'f10a_nbrTooManyMutCodons' WHEN forbidden THEN 'f11_nbrForbiddenCodons' ELSE '' END AS failure
  FROM cut LEFT JOIN info ON info.var = cut.var AND cut.n = 125)
"""
_KEPT = ANN + ", kept AS (SELECT *, rf || '_' || ls AS sample FROM ann WHERE failure = '')"
_COUNTS = _KEPT + ", cnt AS (SELECT codon AS mutantName, sample, count(*) AS value FROM kept GROUP BY 1, 2), smp AS (SELECT DISTINCT rf || '_' || ls AS sample FROM ann), nam AS (SELECT DISTINCT mutantName FROM cnt), dense AS (SELECT mutantName, sample, coalesce(value, 0) AS value FROM nam CROSS JOIN smp LEFT JOIN cnt USING (mutantName, sample))"


def _dna(key: str, n: int) -> str:
    return f"substr({DNA.format(key)}, 1, {n})"


def _trend_sql(rounds: int = 3) -> str:
    """Local lines at the ends of a hundred ranges, refitted without outliers."""
    sql = _COUNTS + """, lg AS (SELECT mutantName, sample, ln(value + 0.5) AS v, round(avg(ln(value + 0.5)) OVER (PARTITION BY mutantName), 9) AS x FROM dense),
      dv AS (SELECT mutantName, sample, x, v - x AS y FROM lg), pt AS (SELECT mutantName, any_value(x) AS x FROM dv GROUP BY 1),
      lim AS (SELECT min(x) AS lo, max(x) AS hi, cast(greatest(floor(count(*) * 0.3 + 1e-7), 2) AS int) AS k FROM pt),
      ends AS (SELECT min(x) AS a, max(x) AS b FROM pt, lim GROUP BY least(floor((x - lo) / (hi - lo) * 100), 99)), an AS (SELECT a FROM ends UNION SELECT b FROM ends),
      rch AS (SELECT a, list_sort(list(abs(x - a)))[any_value(k)] AS h FROM an, pt, lim GROUP BY a),
      w AS (SELECT mutantName, a, power(greatest(1 - power(abs(x - a) / h, 3), 0), 3) AS w FROM rch, pt WHERE abs(x - a) < h),
      nb AS (SELECT mutantName, any_value(x) AS x, max(a) FILTER (a <= x) AS p, min(a) FILTER (a >= x) AS q FROM pt, an GROUP BY 1),
      rb0 AS (SELECT mutantName, sample, 1.0::double AS b FROM dv)"""
    for i in range(rounds + 1):
        sql += f""", s{i} AS (SELECT sample, a, sum(w * b) AS n, sum(w * b * (x - a)) / sum(w * b) AS mx, sum(w * b * (x - a) * (x - a)) / sum(w * b) AS xx, sum(w * b * y) / sum(w * b) AS my, sum(w * b * (x - a) * y) / sum(w * b) AS xy
        FROM w JOIN dv USING (mutantName) JOIN rb{i} USING (mutantName, sample) GROUP BY 1, 2),
      f{i} AS (SELECT sample, a, my - mx * CASE WHEN xx - mx * mx <= power(1e-3 * (hi - lo), 2) THEN 0 ELSE (xy - mx * my) / (xx - mx * mx) END AS v FROM s{i}, lim),
      e{i} AS (SELECT dv.mutantName, dv.sample, abs(y - CASE WHEN p = q THEN g.v ELSE g.v + (nb.x - p) / (q - p) * (h.v - g.v) END) AS e FROM dv JOIN nb USING (mutantName) JOIN f{i} g ON g.sample = dv.sample AND g.a = p JOIN f{i} h ON h.sample = dv.sample AND h.a = q),
      m{i} AS (SELECT sample, 6 * quantile_cont(e, 0.5) AS c, avg(e) AS u FROM e{i} GROUP BY 1),
      rb{i + 1} AS (SELECT mutantName, sample, CASE WHEN c > 1e-7 * u THEN power(greatest(1 - power(e / c, 2), 0), 2) ELSE 1 END AS b FROM e{i} JOIN m{i} USING (sample))"""
    return sql + f" SELECT sample, round(a, 6) AS abundance, round(v, 6) AS deviation FROM f{rounds}"


_STEPS = ["nbrTotal", *FILTERS, "nbrRetained"]
ORACLE_SQL: dict[str, str] = {
    "digest_summary": _KEPT + """ SELECT codon AS mutantName, string_agg(DISTINCT var, ',' ORDER BY var) AS sequence, count(*) AS nbrReads, count(*) AS maxNbrReads, count(DISTINCT umi) AS nbrUmis,
      array_to_string(list_sort(list_distinct(list(nb))), ',') AS nbrMutBases, array_to_string(list_sort(list_distinct(list(nc))), ',') AS nbrMutCodons, array_to_string(list_sort(list_distinct(list(na))), ',') AS nbrMutAAs, '96' AS varLengths,
      string_agg(DISTINCT base, ',' ORDER BY base) AS mutantNameBase, codon AS mutantNameCodon, string_agg(DISTINCT hb, ',' ORDER BY hb) AS mutantNameBaseHGVS, string_agg(DISTINCT aa, ',' ORDER BY aa) AS mutantNameAA, string_agg(DISTINCT ha, ',' ORDER BY ha) AS mutantNameAAHGVS,
      max(types) AS mutationTypes, string_agg(DISTINCT protein, ',' ORDER BY protein) AS sequenceAA
      FROM kept JOIN prot USING (var) JOIN (SELECT info.var, CASE WHEN info.nb = 0 THEN 'f:c' WHEN info.nb = 1 THEN 'f:c.' || lo || wlo || '>' || substr(info.var, lo, 1) ELSE 'f:c.' || lo || '_' || hi || 'delins' || substr(info.var, lo, hi - lo + 1) END AS hb FROM info LEFT JOIN (SELECT var, min(p) AS lo, max(p) AS hi, arg_min(w, p) AS wlo FROM bas GROUP BY var) x ON x.var = info.var) h USING (var)
      JOIN (SELECT info.var, coalesce('f:p.(' || t1 || p || t2 || ')', 'f:p') AS ha FROM info LEFT JOIN (SELECT var, p, a.t AS t1, b.t AS t2 FROM codaa JOIN three a ON a.aa = wa JOIN three b ON b.aa = va WHERE va <> wa) y ON y.var = info.var AND info.nc <= 1) z USING (var) GROUP BY codon""",
    "filter_summary": ANN + " SELECT count(*) AS nbrTotal, " + ", ".join(f"count(*) FILTER (failure = '{f}') AS {f}" for f in FILTERS) + ", count(*) FILTER (failure = '') AS nbrRetained FROM ann",
    "error_statistics": _KEPT + f""", e AS (SELECT q, substr(const, i + 1, 1) = substr('{CONST}', i + 1, 1) AS ok FROM kept, (SELECT unnest(range(18)) AS i)),
      s AS (SELECT q, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS b FROM e GROUP BY q)
      SELECT cast(x AS int) AS PhredQuality, coalesce(a, 0) AS nbrMatchForward, coalesce(b, 0) AS nbrMismatchForward, cast(0 AS bigint) AS nbrMatchReverse, cast(0 AS bigint) AS nbrMismatchReverse FROM (SELECT unnest(range(100)) AS x) LEFT JOIN s ON q = x""",
    "distances": f"""WITH p AS (SELECT p_partkey AS id, {_dna('p_partkey', 12)} AS a, {_dna('p_partkey + 1', 12)} AS b FROM part),
      sh AS (SELECT id, a, b, s, 2 * abs(s) + hamming(substr(a, cast(greatest(s, 0) + 1 AS int), cast(12 - abs(s) AS int)), substr(b, cast(greatest(-s, 0) + 1 AS int), cast(12 - abs(s) AS int))) AS d FROM p, (SELECT unnest(range(-11, 12)) AS s))
      SELECT id, CAST(hamming(any_value(a), any_value(b)) AS BIGINT) AS hamming, CAST(least(12, min(d)) AS BIGINT) AS hamming_shift, CAST(least(12, min(d) FILTER (abs(s) <= 2)) AS BIGINT) AS hamming_shift2, CAST(levenshtein(any_value(a), any_value(b)) AS BIGINT) AS levenshtein FROM sh GROUP BY id""",
    "sequence_functions": f"""WITH code(c, aa) AS (VALUES {_CODE}), p AS (SELECT p_partkey AS id, {_dna('p_partkey', 31)} AS s FROM part),
      t AS (SELECT id, string_agg(aa, '' ORDER BY i) AS protein FROM (SELECT id, i, substr(s, 3 * i + 1, 3) AS c FROM p, (SELECT unnest(range(10)) AS i)) JOIN code USING (c) GROUP BY id),
      q AS (SELECT id, avg(ascii(substr(s, i + 1, 1)) - 33) AS m FROM p, (SELECT unnest(range(31)) AS i) GROUP BY id)
      SELECT id, reverse(translate(s, 'ACGT', 'TGCA')) AS revcomp, protein, length(s) - length(replace(s, 'A', '')) AS n_count, round(m, 6) AS mean_quality FROM p JOIN t USING (id) JOIN q USING (id)""",
    "decompose_sucv": f"SELECT CASE WHEN ok THEN substr(seq1, 2, 10) ELSE '' END AS umi, CASE WHEN ok THEN substr(seq1, 30) ELSE '' END AS var, CASE WHEN ok THEN substr(seq1, 12, 18) ELSE '' END AS const, CASE WHEN ok THEN '96' ELSE '' END AS lengths, CASE WHEN ok THEN '' ELSE 'f3_nbrReadWrongLength' END AS failure, count(*) AS n FROM (SELECT *, length(seq1) = 125 AS ok FROM ({R}) r) GROUP BY ALL",
    "decompose_infer": f"SELECT substr(seq1, 2, 10) AS umi, substr(seq1, 30) AS var, cast(length(seq1) - 29 AS varchar) AS lengths, count(*) AS n FROM ({R}) r GROUP BY ALL",
    "decompose_primer": f"""WITH r AS (SELECT seq1, instr(seq1, '{CONST}') AS a, instr(seq1, 'AAAAAA') AS b FROM ({R}) x), f AS (SELECT seq1, CASE WHEN a > 0 THEN a ELSE b END AS s, CASE WHEN a > 0 THEN 18 ELSE 6 END AS m FROM r)
      SELECT CASE WHEN s = 12 THEN substr(seq1, 2, 10) ELSE '' END AS umi, CASE WHEN s = 12 THEN substr(seq1, s + m) ELSE '' END AS var, CASE WHEN s = 12 THEN cast(length(seq1) - s - m + 1 AS varchar) ELSE '' END AS lengths, CASE WHEN s = 0 THEN 'f2_nbrNoPrimer' WHEN s <> 12 THEN 'f3_nbrReadWrongLength' ELSE '' END AS failure, count(*) AS n FROM f GROUP BY ALL""",
    "limit_reads": f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS read_idx, {DNA.format('o_orderkey')} AS seq1 FROM orders ORDER BY o_orderkey LIMIT 1000",
    "fastq_mates": f"SELECT read_idx, seq1, seq2, length(seq1) AS n_qual1, length(seq2) AS n_qual2 FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS read_idx, {", ".join(MATES_OF_ORDERS)} FROM orders)",
    "filtered_reads": ANN + " SELECT k AS read_idx, CASE failure " + " ".join(f"WHEN '{f}' THEN '{x}'" for f, x in LABELS.items()) + " END AS label, seq1 FROM ann WHERE failure <> ''",
    "fastq_filter_summary": ANN + " SELECT count(*) AS nbrTotal, " + ", ".join(f"count(*) FILTER (failure = '{f}') AS {f}" for f in FILTERS) + ", count(*) FILTER (failure = '') AS nbrRetained FROM ann",
    "filter_outcomes": f"""WITH r AS ({SHORT_READS.replace("{lineitem}", "lineitem")}),
      c AS (SELECT *, ascii(substr(qual1, 1, 1)) - 33 AS q, substr(seq1, 1, 4) AS umi, substr(seq1, 5, 6) AS const, substr(seq1, 11) AS var FROM r),
      d AS (SELECT *, CASE WHEN length(var) = 12 THEN hamming(var, '{SHORT[0]}') ELSE 99 END AS d1, CASE WHEN length(var) = 12 THEN hamming(var, '{SHORT[1]}') ELSE 99 END AS d2, list_sort([hamming(const, x) FOR x IN ['{"', '".join(SHORT_CONST)}']]) AS dc FROM c),
      e AS (SELECT *, CASE WHEN d1 < d2 THEN 'a' ELSE 'b' END AS nm, CASE WHEN d1 < d2 THEN '{SHORT[0]}' ELSE '{SHORT[1]}' END AS w FROM d),
      g AS (SELECT *, list_filter(range(12), lambda i: substr(var, cast(i + 1 AS int), 1) <> substr(w, cast(i + 1 AS int), 1)) AS m FROM e),
      f AS (SELECT *, CASE WHEN contains(seq1, 'GGTTGGCC') THEN 'f1_nbrAdapter' WHEN length(seq1) <> 22 THEN 'f3_nbrReadWrongLength' WHEN q < 20 THEN 'f5_nbrAvgVarQualTooLow' WHEN contains(var, 'N') THEN 'f6_nbrTooManyNinVar' WHEN contains(umi, 'N') THEN 'f7_nbrTooManyNinUMI'
        WHEN least(d1, d2) > 2 THEN 'f10b_nbrTooManyMutBases' WHEN d1 = d2 THEN 'f8_nbrTooManyBestWTHits' WHEN len(m) > 0 AND q < 25 THEN 'f9_nbrMutQualTooLow'
        WHEN len(list_filter(m, lambda i: substr(var, cast(3 * (i // 3) + 3 AS int), 1) IN ('A', 'T'))) > 0 THEN 'f11_nbrForbiddenCodons' WHEN dc[1] > 1 THEN 'f12_nbrTooManyMutConstant' WHEN dc[1] = dc[2] THEN 'f13_nbrTooManyBestConstantHits' ELSE '' END AS failure FROM g)
      SELECT failure, CASE WHEN failure <> '' THEN '' WHEN len(m) = 0 THEN nm || '.0.WT' ELSE array_to_string(list_transform(m, lambda i: nm || '.' || (i + 1) || '.' || substr(var, cast(i + 1 AS int), 1)), '_') END AS name,
        CASE WHEN failure = '' THEN '12' ELSE '' END AS lengths, count(*) AS n, count(DISTINCT CASE WHEN failure = '' THEN umi ELSE '' END) AS n_umis FROM f GROUP BY 1, 2, 3""",
    "paired_outcomes": f"""WITH r AS ({PAIRS.replace("{lineitem}", "lineitem")}), c AS (SELECT substr(seq1, 1, 6) || substr(seq2, 1, 4) AS umi, substr(seq1, 7) AS v, substr(seq2, 5) AS w FROM r),
      d AS (SELECT *, list_filter(range(16), lambda i: substr(v, cast(3 * i + 1 AS int), 3) <> substr('{WILD[:48]}', cast(3 * i + 1 AS int), 3)) AS m, list_filter(range(16), lambda i: substr(w, cast(3 * i + 1 AS int), 3) <> substr('{WILD[48:]}', cast(3 * i + 1 AS int), 3)) AS o FROM c)
      SELECT '' AS failure, CASE WHEN len(m) = 0 THEN 'f.0.WT' ELSE 'f.' || (m[1] + 1) || '.' || substr(v, cast(3 * m[1] + 1 AS int), 3) END || '_' || CASE WHEN len(o) = 0 THEN 'r.0.WT' ELSE 'r.' || (o[1] + 1) || '.' || substr(w, cast(3 * o[1] + 1 AS int), 3) END AS name,
        '48_48' AS lengths, count(*) AS n, count(DISTINCT umi) AS n_umis FROM d GROUP BY 2""",
    "merged_outcomes": f"""WITH r AS ({MATES.replace("{lineitem}", "lineitem")}), c AS (SELECT seq1 AS f, reverse(translate(seq2, 'ACGT', 'TGCA')) AS s FROM r),
      d AS (SELECT substr(f, 37) = substr(s, 1, 24) AS ok, f || substr(s, 25) AS v FROM c), e AS (SELECT *, list_filter(range(32), lambda i: substr(v, cast(3 * i + 1 AS int), 3) <> substr('{WILD}', cast(3 * i + 1 AS int), 3)) AS m FROM d)
      SELECT CASE WHEN ok THEN '' ELSE 'f4_nbrNoValidOverlap' END AS failure, CASE WHEN NOT ok THEN '' WHEN len(m) = 0 THEN 'f.0.WT' ELSE 'f.' || (m[1] + 1) || '.' || substr(v, cast(3 * m[1] + 1 AS int), 3) END AS name, CASE WHEN ok THEN '96' ELSE '' END AS lengths, count(*) AS n, cast(1 AS bigint) AS n_umis FROM e GROUP BY 1, 2, 3""",
    "umi_collapse": "WITH RECURSIVE " + _KEPT.strip().removeprefix("WITH") + """, us AS (SELECT codon AS mutantName, list_sort(list_distinct(list(umi))) AS us FROM kept GROUP BY 1),
      st AS (SELECT mutantName, us, 1 AS i, [us[1]] AS kept FROM us UNION ALL SELECT mutantName, us, i + 1, CASE WHEN len(list_filter(kept, lambda x: hamming(x, us[i + 1]) <= 3)) > 0 THEN kept ELSE list_append(kept, us[i + 1]) END FROM st WHERE i < len(us))
      SELECT mutantName, len(kept) AS n, array_to_string(kept, ',') AS kept FROM st WHERE i = len(us)""",
    "similarity_groups": f"""WITH RECURSIVE p AS (SELECT {_dna('p_partkey', 8)} AS s, count(*) AS score FROM part GROUP BY 1), o AS (SELECT s, score, row_number() OVER (ORDER BY score DESC, s) AS i FROM p),
      st AS (SELECT i, s, s AS rep, [{{'s': s, 'v': score}}] AS reps FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.s, coalesce(list_filter(reps, lambda x: hamming(x.s, o.s) <= 1 AND x.v >= o.score)[1].s, o.s), CASE WHEN len(list_filter(reps, lambda x: hamming(x.s, o.s) <= 1 AND x.v >= o.score)) > 0 THEN reps ELSE list_append(reps, {{'s': o.s, 'v': o.score}}) END FROM st JOIN o ON o.i = st.i + 1)
      SELECT s AS sequence, rep AS representative FROM st""",
    "similarity_groups_variants": "WITH RECURSIVE " + _KEPT.strip().removeprefix("WITH") + """, p AS (SELECT var AS s, count(*) AS score FROM kept GROUP BY 1), o AS (SELECT s, score, row_number() OVER (ORDER BY score DESC, s) AS i FROM p),
      st AS (SELECT i, s, s AS rep, [{'s': s, 'v': score}] AS reps FROM o WHERE i = 1
        UNION ALL SELECT o.i, o.s, coalesce(list_filter(reps, lambda x: x.v >= 3 AND x.v >= 1.5 * o.score AND hamming(x.s, o.s) <= 2)[1].s, o.s),
          CASE WHEN len(list_filter(reps, lambda x: x.v >= 3 AND x.v >= 1.5 * o.score AND hamming(x.s, o.s) <= 2)) > 0 THEN reps ELSE list_append(reps, {'s': o.s, 'v': o.score}) END FROM st JOIN o ON o.i = st.i + 1)
      SELECT s AS sequence, rep AS representative FROM st""",
    "variant_neighbours": _KEPT + """, p AS (SELECT DISTINCT var AS s FROM kept) SELECT a.s AS sequence, count(*) FILTER (hamming(a.s, b.s) = 1) AS n_1, count(*) FILTER (hamming(a.s, b.s) = 2) AS n_2
      FROM p a JOIN p b ON a.s <> b.s WHERE hamming(a.s, b.s) <= 2 GROUP BY 1""",
    "summarize_samples": _KEPT + " SELECT codon AS mutantName, sample, count(DISTINCT umi) AS value FROM kept WHERE sample IN ('A_F', 'R_F') GROUP BY 1, 2",
    "nearest_string_dist": f"WITH s AS (SELECT s_suppkey AS id, {_dna('s_suppkey', 12)} AS s FROM supplier) SELECT a.id, cast(min(hamming(a.s, b.s)) AS int) AS dist FROM s a JOIN s b ON a.id <> b.id GROUP BY a.id",
    "nearest_by_edits": f"""WITH s AS (SELECT s_suppkey AS id, {_dna('s_suppkey', 12)} AS s FROM supplier),
      d AS (SELECT a.id, levenshtein(a.s, b.s) AS e, list_min(list_transform(range(-11, 12), lambda k: 2 * abs(k) + hamming(substr(a.s, cast(greatest(k, 0) + 1 AS int), cast(12 - abs(k) AS int)), substr(b.s, cast(greatest(-k, 0) + 1 AS int), cast(12 - abs(k) AS int))))) AS h
        FROM s a JOIN s b ON a.id <> b.id) SELECT id, cast(min(e) AS int) AS levenshtein, cast(least(12, min(h)) AS int) AS hamming_shift FROM d GROUP BY id""",
    "similarity_search": f"WITH p AS (SELECT DISTINCT {_dna('p_partkey', 12)} AS m FROM part), q AS (SELECT DISTINCT {_dna('s_suppkey', 12)} AS q FROM supplier) SELECT q AS query, m AS match, cast(hamming(q, m) AS int) AS dist FROM q, p WHERE hamming(q, m) <= 3",
    "index_updates": f"""WITH p AS (SELECT DISTINCT {_dna('p_partkey', 10)} AS s FROM part), c AS (SELECT DISTINCT {_dna('c_custkey', 10)} AS s FROM customer), u AS (SELECT DISTINCT {_dna('s_suppkey', 10)} AS s FROM supplier),
      o AS (SELECT s, row_number() OVER (ORDER BY s) AS place FROM p), left_ AS (SELECT * FROM o WHERE s NOT IN (SELECT s FROM c)),
      tomb AS (SELECT s, place FROM o WHERE s IN (SELECT s FROM c)), merged AS (SELECT (SELECT count(*) FROM tomb) >= (SELECT count(*) FROM left_) // 2 AS yes),
      back AS (SELECT tomb.* FROM tomb, merged WHERE NOT yes AND s IN (SELECT s FROM u)),
      have AS (SELECT * FROM left_ UNION ALL SELECT * FROM back),
      new AS (SELECT s, (SELECT count(*) FROM p) + row_number() OVER (ORDER BY s) AS place FROM u WHERE s NOT IN (SELECT s FROM have)), i AS (SELECT * FROM have UNION ALL SELECT * FROM new)
      SELECT 'hamming' AS metric, c.s AS query, i.s AS match, hamming(c.s, i.s) AS dist, place FROM c, i WHERE hamming(c.s, i.s) <= 2
      UNION ALL SELECT 'levenshtein', c.s, i.s, levenshtein(c.s, i.s), place FROM c, i WHERE levenshtein(c.s, i.s) <= 2""",
    "nearest_reference": f"""WITH n AS (SELECT n_nationkey AS i, {_dna('n_nationkey', 12)} AS r FROM nation), p AS (SELECT p_partkey AS id, {_dna('p_partkey', 12)} AS s FROM part),
      d AS (SELECT id, i, hamming(s, r) AS d FROM p, n), m AS (SELECT id, min(d) AS b FROM d GROUP BY id)
      SELECT id, cast(CASE WHEN any_value(b) > 8 THEN -1 WHEN count(*) > 1 THEN -2 ELSE min(i) END AS int) AS idx FROM d JOIN m USING (id) WHERE d = b GROUP BY id""",
    "indexed_reference": f"""WITH n AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i FROM ({REFERENCES.replace("{nation}", "nation")})), p AS ({CHANGED.replace("{customer}", "customer")}),
      d AS (SELECT id, i, hamming(s, r) AS d FROM p, n), m AS (SELECT id, min(d) AS b FROM d GROUP BY id)
      SELECT id, cast(CASE WHEN any_value(b) > 1 THEN -1 WHEN count(*) > 1 THEN -2 ELSE min(i) END AS int) AS idx FROM d JOIN m USING (id) WHERE d = b GROUP BY id""",
    "merge_pairs": f"SELECT p_partkey AS read_idx, {DNA.format('p_partkey')} AS merged, true AS valid FROM part",
    "summarize_experiment": _KEPT + " SELECT codon AS mutantName, sample, count(DISTINCT umi) AS value FROM kept GROUP BY 1, 2",
    "variant_annotations": _KEPT + " SELECT codon AS mutantName, string_agg(DISTINCT var, ',' ORDER BY var) AS sequence, array_to_string(list_sort(list_distinct(list(nb))), ',') AS nbrMutBases, min(nb) AS minNbrMutBases, max(na) AS maxNbrMutAAs, string_agg(DISTINCT aa, ',' ORDER BY aa) AS mutantNameAA, max(types) AS mutationTypes FROM kept GROUP BY codon",
    "collapse_aa": _KEPT + " SELECT aa AS mutantName, sample, count(*) AS value FROM kept GROUP BY 1, 2",
    "relabel": _KEPT + " SELECT DISTINCT codon AS mutantName, CASE WHEN cast(split_part(codon, '.', 2) AS int) % 3 = 0 THEN 'f.p' || (cast(split_part(codon, '.', 2) AS int) + 100) || '.' || split_part(codon, '.', 3) ELSE codon END AS newName FROM kept",
    "totals": _KEPT + " SELECT sample, count(*) AS total FROM kept GROUP BY sample",
    "knee": _COUNTS + " SELECT mutantName, sample, value, row_number() OVER (PARTITION BY sample ORDER BY value DESC, mutantName) AS idx FROM cnt",
    "count_histogram": _COUNTS + " SELECT sample, cast(least(9, floor(log10(value + 1) / 0.5)) AS bigint) AS bin, count(*) AS n FROM dense GROUP BY 1, 2",
    "pairs_correlation": _COUNTS + " SELECT a.sample AS sample1, b.sample AS sample2, round(corr(log10(a.value + 1), log10(b.value + 1)), 6) AS cor FROM dense a JOIN dense b ON a.mutantName = b.mutantName AND a.sample < b.sample GROUP BY 1, 2",
    "pairs_spearman": _COUNTS + ", rk AS (SELECT mutantName, sample, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0 AS v FROM dense) SELECT a.sample AS sample1, b.sample AS sample2, round(corr(a.v, b.v), 6) AS cor FROM rk a JOIN rk b ON a.mutantName = b.mutantName AND a.sample < b.sample GROUP BY 1, 2",
    "pair_density": _COUNTS + """, lv AS (SELECT mutantName, sample, log10(value + 1) AS v FROM dense),
      q AS (SELECT sample, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iq, count(*) AS k FROM lv GROUP BY 1),
      ax AS (SELECT sample, lo, hi, 1.06 * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), 1) * power(k, -0.2) AS h FROM q),
      bn AS (SELECT mutantName, sample, CASE WHEN hi > lo THEN cast(floor((v - lo) / (hi - lo) * 24 + 0.5) AS int) ELSE 0 END AS i FROM lv JOIN ax USING (sample)),
      ce AS (SELECT a.sample AS s1, b.sample AS s2, a.i, b.i AS j, count(*) AS n FROM bn a JOIN bn b ON a.mutantName = b.mutantName AND a.sample < b.sample GROUP BY ALL), tt AS (SELECT s1, s2, sum(n) AS n FROM ce GROUP BY ALL),
      gr AS (SELECT sample, unnest(range(25)) AS g, h, CASE WHEN hi > lo THEN (hi - lo) / 24 ELSE 1 / 24.0::double END AS d, lo FROM ax),
      sx AS (SELECT s1, s2, g, any_value(lo + g * d) AS x, j, sum(n * exp(-0.5 * power((g - i) * d / h, 2)) / (h * sqrt(2 * pi()))) AS n FROM ce JOIN gr ON sample = s1 GROUP BY s1, s2, g, j)
      SELECT s1 AS sample1, s2 AS sample2, round(any_value(x), 6) AS x, round(any_value(lo + gr.g * d), 6) AS y, round(sum(sx.n * exp(-0.5 * power((gr.g - j) * d / h, 2)) / (h * sqrt(2 * pi()))) / any_value(tt.n), 6) AS density
      FROM sx JOIN gr ON sample = s2 JOIN tt USING (s1, s2) GROUP BY s1, s2, sx.g, gr.g""",
    "fitness_score": _COUNTS + """, nrm AS (SELECT mutantName, split_part(sample, '_', 1) AS c, split_part(sample, '_', 2) AS replicate, value * (0.5 + CASE split_part(sample, '_', 1) WHEN 'A' THEN 0 WHEN 'N' THEN 0.25 ELSE 0.5 END + CASE split_part(sample, '_', 2) WHEN 'F' THEN 0 ELSE 0.1 END) / sum(value) OVER (PARTITION BY sample) AS x FROM dense),
      lg AS (SELECT a.mutantName, a.replicate, log2(nullif(a.x / nullif(b.x, 0), 0)) AS n FROM nrm a JOIN nrm b ON a.mutantName = b.mutantName AND a.replicate = b.replicate AND a.c = 'A' AND b.c = 'R')
      SELECT lg.mutantName, lg.replicate, round(lg.n / w.n, 6) AS fitness FROM lg JOIN lg w ON w.mutantName = 'f.0.WT' AND w.replicate = lg.replicate""",
    "wt_offsets": _COUNTS + """, w AS (SELECT * FROM dense WHERE mutantName LIKE 'f.1.%' OR mutantName = 'f.0.WT'), ok AS (SELECT mutantName FROM w GROUP BY 1 HAVING min(value) > 0),
      l AS (SELECT avg(ln(t)) AS m FROM (SELECT sum(value) AS t FROM dense GROUP BY sample)), o AS (SELECT sample, ln(sum(value)) AS a, avg(ln(nullif(value, 0))) FILTER (mutantName IN (SELECT mutantName FROM ok)) AS b FROM w GROUP BY sample)
      SELECT sample, round(a - avg(a) OVER () + m, 6) AS log_sum, round(b - avg(b) OVER () + m, 6) AS log_geomean FROM o, l""",
    "tmm": _COUNTS + """, lib AS (SELECT sample, sum(value)::double AS n, quantile_cont(value, 0.75) / sum(value) AS q FROM dense GROUP BY 1),
      ref AS (SELECT sample AS rs, n AS rn FROM (SELECT *, row_number() OVER (ORDER BY abs(q - (SELECT avg(q) FROM lib)), sample) AS i FROM lib) WHERE i = 1),
      p AS (SELECT a.sample, log2((a.value / l.n) / (b.value / rn)) AS m, (log2(a.value / l.n) + log2(b.value / rn)) / 2 AS a, (l.n - a.value) / l.n / a.value + (rn - b.value) / rn / b.value AS v
        FROM dense a JOIN lib l USING (sample) CROSS JOIN ref JOIN dense b ON b.mutantName = a.mutantName AND b.sample = rs WHERE a.sample <> rs AND a.value > 0 AND b.value > 0),
      c AS (SELECT sample, list_sort(list(m)) AS ms, list_sort(list(a)) AS xs, count(*) AS k FROM p GROUP BY 1),
      l AS (SELECT sample, ms[cast(floor(k * 0.3) AS int) + 1] AS m1, ms[cast(k - floor(k * 0.3) AS int)] AS m2, xs[cast(floor(k * 0.05) AS int) + 1] AS a1, xs[cast(k - floor(k * 0.05) AS int)] AS a2 FROM c),
      f AS (SELECT sample, sum(m / v) / sum(1 / v) * ln(2) AS f FROM p JOIN l USING (sample) WHERE m BETWEEN m1 AND m2 AND a BETWEEN a1 AND a2 GROUP BY 1),
      g AS (SELECT sample, n, coalesce(f, 0) AS f FROM lib LEFT JOIN f USING (sample)) SELECT sample, round(ln(n) + f - avg(f) OVER (), 6) AS log_library FROM g""",
    "abundance_trends": _trend_sql(),
    "bh_adjust": "WITH p AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 10007 + 1) / 20000.0::double AS p FROM part), r AS (SELECT id, p, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS n FROM p) SELECT id, round(least(1.0, min(p * n / k) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS padj FROM r",
    "volcano_points": "WITH r AS (SELECT cast(p_partkey AS varchar) AS mutantName, ((p_partkey * 31) % 200 - 100) / 25.0::double AS x, ((p_partkey * 7919) % 10007 + 1) / 20000.0::double AS p, ((p_partkey * 7919) % 10007 + 1) / 10008.0::double AS fdr FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, mutantName) AS i FROM r) SELECT mutantName, round(x, 6) AS x, round(-log10(p), 6) AS y, fdr < 0.05 AS significant, i <= 10 AS labelled FROM k",
    "filter_waterfall": ANN + ", f AS (SELECT rf || '_' || ls AS sample, failure, count(*) AS n FROM ann GROUP BY 1, 2), t AS (SELECT sample, sum(n)::bigint AS total FROM f GROUP BY 1), steps(step, i) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(_STEPS)) + """),
      a AS (SELECT t.sample, step, i, total, CASE WHEN step = 'nbrTotal' THEN total ELSE coalesce(n, 0) END AS n FROM t CROSS JOIN steps LEFT JOIN f ON f.sample = t.sample AND f.failure = CASE WHEN step = 'nbrRetained' THEN '' ELSE step END),
      act AS (SELECT step FROM a GROUP BY step HAVING max(n) > 0)
      SELECT sample, step, cast(i AS bigint) AS step_idx, cast(n AS bigint) AS nbrReads, CASE WHEN n = 0 THEN 0.0 ELSE round(n / total * pow(10.0, 2 - floor(log10(n / total)))) / pow(10.0, 2 - floor(log10(n / total))) END AS fracReads,
      cast(total - sum(CASE WHEN step IN ('nbrTotal', 'nbrRetained') THEN 0 ELSE n END) OVER (PARTITION BY sample ORDER BY i) AS bigint) AS cumulNbr FROM a WHERE step IN (SELECT step FROM act)""",
    "link_variants": _KEPT + f""", naive AS (SELECT var, count(*) OVER (PARTITION BY codon) AS n FROM kept QUALIFY row_number() OVER (PARTITION BY codon, var ORDER BY k) = 1),
      nm AS (SELECT var, coalesce(string_agg('v1.' || p || '.' || v, '_' ORDER BY p) FILTER (p <= 16), 'v1.0.WT') AS V1, coalesce(string_agg('v2.' || (p - 16) || '.' || v, '_' ORDER BY p) FILTER (p > 16), 'v2.0.WT') AS V2 FROM cod GROUP BY var)
      SELECT coalesce(V1, 'v1.0.WT') AS V1, coalesce(V2, 'v2.0.WT') AS V2, cast(sum(n) AS bigint) AS nbrReads FROM naive LEFT JOIN nm USING (var) GROUP BY 1, 2""",
    "variant_names": ANN + """, grp AS (SELECT var, p, v, w, sum(CASE WHEN d <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY var ORDER BY p) AS gi FROM (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY var ORDER BY p), 99) AS d FROM bas)),
      g1 AS (SELECT var, gi, min(p) AS lo, max(p) AS hi, arg_min(w, p) AS wlo FROM grp GROUP BY 1, 2),
      g2 AS (SELECT var, count(*) AS m, string_agg(CASE WHEN lo = hi THEN lo || wlo || '>' || substr(var, lo, 1) ELSE lo || '_' || hi || 'delins' || substr(var, lo, hi - lo + 1) END, ';' ORDER BY lo) AS ids FROM g1 GROUP BY var),
      a1 AS (SELECT var, count(*) AS m, string_agg('(' || a.t || p || b.t || ')', ';' ORDER BY p) AS ids FROM codaa JOIN three a ON a.aa = wa JOIN three b ON b.aa = va WHERE va <> wa GROUP BY var)
      SELECT info.var, base AS name_base, codon AS name_codon, info.aa AS name_aa, CASE WHEN g2.m IS NULL THEN 'f:c' WHEN g2.m = 1 THEN 'f:c.' || g2.ids ELSE 'f:c.[' || g2.ids || ']' END AS hgvs_base, CASE WHEN a1.m IS NULL THEN 'f:p' WHEN a1.m = 1 THEN 'f:p.' || a1.ids ELSE 'f:p.[' || a1.ids || ']' END AS hgvs_aa, types
      FROM info LEFT JOIN g2 USING (var) LEFT JOIN a1 USING (var) WHERE NOT contains(info.var, 'N')""",
    "merge_values": "WITH t AS (SELECT cast(l_suppkey AS bigint) AS name, unnest([l_returnflag, l_linestatus]) AS v FROM lineitem) SELECT name, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM t GROUP BY name",
}
