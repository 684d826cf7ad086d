import gzip
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mavelake.operators import digest as D
from mavelake.operators import experiment as X
from mavelake.operators import qc, stats
from mavelake.operators.link import link_multiple_variants
from mavelake.plans import queries
from mavelake.sources.fastq import read_fastq
from mavelake.spec import DigestSpec
from mavelake.streaming.digest_stream import filter_counts

WT = "ACGACGACGACG"


def write(path, reads):
    with gzip.open(path, "wt") as f:
        for i, (s, q) in enumerate(reads):
            f.write(f"@r{i}\n{s}\n+\n{q}\n")
    return str(path)


def simulated(n=200, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = list(WT)
        if i % 3:
            v[rng.integers(12)] = rng.choice(list("ACGT"))
        umi = "".join(rng.choice(list("ACGT"), 4))
        out.append((umi + "TTTT" + "".join(v), "I" * 20 if i % 7 else "#" * 20))
    return out


ARGS = dict(elementsForward="UCV", elementLengthsForward=[4, 4, 12], wildTypeForward=WT, constantForward="TTTT", forbiddenMutatedCodonsForward="NNW")


def test_digest_invariants(spark, tmp_path):
    reads = simulated()
    whole = write(tmp_path / "a.fastq.gz", reads)
    one = D.digest_fastqs(spark, fastqForward=whole, filteredReadsFastqForward=str(tmp_path / "lost.fastq.gz"), verbose=True, **ARGS)
    f = one.filterSummary.toPandas().iloc[0]
    table = one.summaryTable.toPandas()
    assert f.nbrTotal == 200 and f.nbrTotal - f.filter(like="f").filter(regex="^f").sum() == f.nbrRetained == table.nbrReads.sum()
    assert list(table.mutantName) == sorted(table.mutantName)
    e = one.errorStatistics.toPandas()
    assert len(e) == 100 and e.nbrMatchForward.sum() + e.nbrMismatchForward.sum() == 4 * f.nbrRetained
    with gzip.open(tmp_path / "lost.fastq.gz", "rt") as lines:  # one file, as any tool reads it
        lost = lines.read().split("\n")[:-1]
    assert len(lost) == 4 * (f.nbrTotal - f.nbrRetained) and all(x.startswith("@S") for x in lost[::4]) and {(a, b) for a, b in zip(lost[1::4], lost[3::4], strict=True)} <= set(reads)
    # the same reads in two files, and twice
    a, b = write(tmp_path / "b.fastq.gz", reads[:77]), write(tmp_path / "c.fastq.gz", reads[77:])
    two = D.digest_fastqs(spark, fastqForward=[a, b], **ARGS)
    assert two.summaryTable.toPandas().equals(table)
    twice = D.digest_fastqs(spark, fastqForward=[whole, whole], **ARGS).summaryTable.toPandas()
    assert (twice.nbrReads == 2 * table.nbrReads).all() and (twice.nbrUmis == table.nbrUmis).all()
    limited = read_fastq(spark, [a, b], max_n_reads=100)
    assert limited.count() == 100 and limited.agg(F.max("read_idx")).first()[0] == 99
    collapsed = D.digest_fastqs(spark, fastqForward=whole, umiCollapseMaxDist=4, **ARGS).summaryTable.toPandas()
    assert (collapsed.nbrUmis == 1).all()


def test_fastq_source(spark, tmp_path):
    p = tmp_path / "x.fastq"
    p.write_text("@a\nACGT\n+\nIIII\n@b\r\nAC\r\n+\r\nII\r\n@c\nA\n")
    rows = read_fastq(spark, str(p)).collect()
    assert [(r.read_idx, r.seq1, r.qual1, r.seq2) for r in rows] == [(0, "ACGT", "IIII", None), (1, "AC", "II", None)]
    m = tmp_path / "y.fastq"
    m.write_text("@a\nTT\n+\nII")
    assert [(r.seq1, r.seq2) for r in read_fastq(spark, str(p), str(m)).collect()] == [("ACGT", "TT")]
    with pytest.raises(Exception, match="longer than maxReadLength"):
        read_fastq(spark, str(p), max_read_length=3).collect()


def brute_umis(umis, tol):
    kept = []
    for u in sorted(set(umis)):
        if not any(sum(a != b for a, b in zip(u, k, strict=True)) <= tol for k in kept):
            kept.append(u)
    return kept


def test_umi_collapse(spark):
    rng = np.random.default_rng(3)
    sets = [["".join(rng.choice(list("ACG"), 4)) for _ in range(20)] for _ in range(5)]
    df = spark.createDataFrame([(i, u) for i, s in enumerate(sets) for u in s], "i int, umi string")
    got = D.collapse_umis(df, 1, ["i"]).groupBy("i").agg(F.array_sort(F.collect_list("umi")).alias("k")).collect()
    assert {r.i: r.k for r in got} == {i: brute_umis(s, 1) for i, s in enumerate(sets)}


@pytest.fixture(scope="module")
def se(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fq")
    x, rows = {}, []
    for i, c in enumerate(("in", "out")):
        for r in (1, 2):
            n = f"{c}{r}"
            x[n] = D.digest_fastqs(spark, fastqForward=write(folder / f"{n}.fastq.gz", simulated(300, 10 * i + r)), **ARGS)
            rows.append({"Name": n, "Condition": c, "Replicate": r, "OD": 0.5 + i})
    return X.summarize_experiment(x, pd.DataFrame(rows), "umis")


def test_experiment(spark, se, tmp_path):
    wide = se.dense().toPandas().set_index("mutantName")
    assert list(wide.columns) == se.samples == ["in1", "in2", "out1", "out2"]
    aa = X.collapse_mutants_by_aa(se)
    assert aa.dense().toPandas()[se.samples].sum().sum() == wide.sum().sum()
    near = X.collapse_mutants_by_similarity(se, "counts", collapseMaxDist=100)
    assert near.row_data.count() == 1
    se.metadata.pop("errorStatistics", None)
    se.save(str(tmp_path / "se"))
    again = X.Experiment.load(spark, str(tmp_path / "se"))
    assert again.samples == se.samples and again.dense().count() == len(wide)
    with pytest.raises(ValueError):
        X.collapse_mutants(se, "no such column")


def test_unnamed_assay(se):
    """The only assay is taken if it has no name, with a warning; one of another name isn't."""
    design = np.array([[1, 0], [1, 0], [1, 1], [1, 1]])
    counts = se.assays.where("assay = 'counts'")
    plain = X.Experiment(counts.withColumn("assay", F.lit("")), se.row_data, se.col_data)
    with pytest.warns(UserWarning, match="no name"):
        got = stats.calculate_relative_fc(plain, design, coef=1, method="limma").toPandas()
    assert got.equals(stats.calculate_relative_fc(se, design, coef=1, method="limma").toPandas())
    with pytest.raises(ValueError):
        stats.calculate_relative_fc(X.Experiment(counts.withColumn("assay", F.lit("x")), se.row_data, se.col_data), design, coef=1)


def test_fitness(se):
    f = stats.calculate_fitness_score(se, "Replicate", ["OD"], ["Condition", "out", "in"], ["f.0.WT"]).toPandas().set_index("mutantName")
    wide = se.dense().toPandas().set_index("mutantName")
    for r in (1, 2):
        with np.errstate(all="ignore"):
            n = np.log2((wide[f"out{r}"] * 1.5 / wide[f"out{r}"].sum()) / (wide[f"in{r}"] * 0.5 / wide[f"in{r}"].sum()))
        want = (n / n["f.0.WT"]).where(np.isfinite(n))
        assert np.allclose(f[f"out_vs_in_repl{r}"], want.loc[f.index], equal_nan=True)
    with pytest.raises(ValueError):
        stats.calculate_fitness_score(se, "Replicate", ["OD"], ["Condition", "out", "nothing"], None)


@pytest.mark.parametrize("method", ["limma", "edgeR"])
def test_relative_fc(se, method):
    design = np.array([[1, 0], [1, 0], [1, 1], [1, 1]], float)
    a = stats.calculate_relative_fc(se, design, coef=1, method=method).toPandas().set_index("mutantName").sort_index()
    b = stats.calculate_relative_fc(se, design, contrast=np.array([0, 1.0]), method=method).toPandas().set_index("mutantName").sort_index()
    assert np.allclose(a.logFC, b.logFC) and len(a) == se.row_data.count()
    p = a["P_Value" if method == "limma" else "PValue"]
    assert p.between(0, 1).all() and p["f.0.WT"] > 0.01
    wt = stats.calculate_relative_fc(se, design, coef=1, method=method, WTrows=["f.0.WT"]).toPandas().set_index("mutantName")
    assert abs(wt.logFC["f.0.WT"]) < 0.3
    for bad in (dict(coef=None), dict(coef=1, normMethod="sum"), dict(coef=1, WTrows=["f.0.WT"], normMethod="TMM")):
        with pytest.raises(ValueError):
            stats.calculate_relative_fc(se, design, method=method, **bad)
    if method == "edgeR":
        assert stats.calculate_relative_fc(se, design, coef=1, normMethod="csaw").count() == len(a)


def test_plots_and_report(se, tmp_path):
    f = qc.plot_filtering(se).toPandas()
    assert (f[f.step == "nbrTotal"].value == 300).all()
    assert qc.plot_filtering(se, valueType="fractions", plotType="filtered", facetBy="step").count() > 0
    assert qc.plot_totals(se, groupBy="mutationTypes").count() > 0
    for kind in ("density", "knee", "histogram"):
        assert qc.plot_distributions(se, plotType=kind, pseudocount=1, groupBy="Condition").count() > 0
    p = qc.plot_pairs(se, corMethod="spearman")
    wide = se.dense().toPandas()[se.samples]
    want = np.log10(wide + 1).rank().corr()
    assert all(abs(r.cor - want.loc[r.sample1, r.sample2]) < 1e-9 for r in p["correlations"].collect())
    out = str(tmp_path / "sub" / "r.html")
    text = open(qc.generate_qc_report(se, out)).read()
    assert "<svg" in text and "not available" not in text
    with pytest.raises(FileExistsError):
        qc.generate_qc_report(se, out)
    with pytest.raises(ValueError):
        qc.generate_qc_report(se, "x.pdf")
    design = np.array([[1, 0], [1, 0], [1, 1], [1, 1]], float)
    res = stats.calculate_relative_fc(se, design, coef=1, method="limma")
    assert qc.plot_mean_diff(res, nTopToLabel=3).where("labelled").count() == 3 and qc.plot_volcano(res).count() == res.count()


def test_link(spark, tmp_path):
    rng = np.random.default_rng(5)
    bars, refs, reads = ["ACGTAC", "GGATCC", "TTTACG"], ["ACGACGACG", "TTGTTGTTG"], []
    truth = {}
    for _ in range(150):
        b, r = bars[rng.integers(3)], refs[rng.integers(2)]
        reads.append((b + "CCCC" + r, "I" * 19))
        truth[b, r] = truth.get((b, r), 0) + 1
    bad = list(reads[0][0])
    bad[2] = "N"
    reads.append(("".join(bad), "I" * 19))
    f = write(tmp_path / "l.fastq.gz", reads)
    both = dict(fastqForward=f, elementsForward="VCV", elementLengthsForward=[6, 4, 9])
    out = link_multiple_variants(spark, both, barcode=dict(fastqForward=f, elementsForward="VCS", elementLengthsForward=[6, 4, 9]), V2=dict(fastqForward=f, elementsForward="SCV", elementLengthsForward=[6, 4, 9], wildTypeForward={"a": refs[0], "b": refs[1]}))
    got = {(r.barcode, r.V2): r.nbrReads for r in out.countAggregated.collect()}
    assert got == {(b, {refs[0]: "a.0.WT", refs[1]: "b.0.WT"}[r]): n for (b, r), n in truth.items()}
    with pytest.raises(ValueError):
        link_multiple_variants(spark, both, x=dict(fastqForward=f, elementsForward="S", elementLengthsForward=[-1]))


def test_partition_invariance_and_stream(spark, tmp_path):
    spec = DigestSpec.of(**ARGS)
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(simulated())], "read_idx long, seq1 string, qual1 string")
    a, b = (D.digest_reads(df.repartition(n), spec).summaryTable.toPandas() for n in (1, 7))
    assert a.equals(b)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = filter_counts(stream, spec).writeStream.outputMode("complete").format("memory").queryName("fc").start()
    q.processAllAvailable()
    q.stop()
    got = {r.failure: r.nbrReads for r in spark.sql("SELECT * FROM fc").collect()}
    assert sum(got.values()) == 200 and got[""] == a.nbrReads.sum()


def test_filtered_reads_with_equal_keys(spark, sf_dir):
    """Every read that a filter takes is returned, also where reads share a key."""
    r = queries.reads(spark, sf_dir)
    assert r.select("read_idx").distinct().count() < r.count()
    lost = D.annotate(r.withColumn("raw", F.col("seq1")), queries.spec(), ("raw",)).where("failure <> ''")
    want = Counter((x.read_idx, D.LABELS[x.failure], x.raw) for x in lost.select("read_idx", "failure", "raw").collect())
    got = Counter((x.read_idx, x.label, x.seq1) for x in queries.filtered_reads(spark, sf_dir).collect())
    assert got == want
