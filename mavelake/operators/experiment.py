"""Experiments: counts of variants by sample in long form, with what is known of variants and samples."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import assert_scalar
from ..plans import ordered, scratch
from .digest import DigestResult
from .similarity import group_similar_sequences

MERGED = ["sequence", "nbrMutBases", "nbrMutCodons", "nbrMutAAs", "mutantNameBase", "mutantNameBaseHGVS", "mutantNameCodon", "mutantNameAA", "mutantNameAAHGVS", "sequenceAA", "mutationTypes", "varLengths"]
NUMBERS = ["nbrMutBases", "nbrMutCodons", "nbrMutAAs"]


@dataclass
class Experiment:
    """assays: (mutantName, sample, assay, value), where absent counts are zero; row_data: a row per variant; col_data: a
    row per sample (Name and more), in the order of `samples`."""

    assays: DataFrame
    row_data: DataFrame
    col_data: pd.DataFrame
    metadata: dict = field(default_factory=dict)

    @property
    def samples(self) -> list[str]:
        return list(self.col_data["Name"])

    def assay(self, name: str = "counts") -> DataFrame:
        return self.assays.where(F.col("assay") == name).select("mutantName", "sample", "value")

    def assay_names(self) -> list[str]:
        return sorted(r.assay for r in self.assays.select("assay").distinct().collect())

    def dense(self, name: str = "counts", samples: list[str] | None = None) -> DataFrame:
        """A row per variant and a column per sample; absent counts are 0."""
        samples = samples or self.samples
        wide = self.assay(name).groupBy("mutantName").pivot("sample", samples).sum("value")
        return self.row_data.select("mutantName").join(wide, "mutantName", "left").na.fill(0.0, samples).select("mutantName", *samples)

    def subset(self, samples: list[str]) -> Experiment:
        cols = self.col_data.set_index("Name", drop=False).loc[samples].reset_index(drop=True)
        return Experiment(self.assays.where(F.col("sample").isin(samples)), self.row_data, cols, self.metadata)

    def save(self, folder: str) -> None:
        """The four parts as Parquet and JSON text, readable by `load`."""
        spark = self.assays.sparkSession
        self.assays.write.mode("overwrite").parquet(f"{folder}/assays")
        self.row_data.write.mode("overwrite").parquet(f"{folder}/row_data")
        text = json.dumps({"col_data": json.loads(self.col_data.to_json(orient="table", index=False)), "metadata": self.metadata}, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Experiment:
        import io

        meta = json.loads(spark.read.text(f"{folder}/meta", wholetext=True).collect()[0].value)
        cols = pd.read_json(io.StringIO(json.dumps(meta["col_data"])), orient="table")
        return cls(spark.read.parquet(os.path.join(folder, "assays")), spark.read.parquet(os.path.join(folder, "row_data")), cols, meta["metadata"])


def merged_set(c: str | Column, delimiter: str = ",") -> Column:
    """Aggregate: the union of delimited sets, sorted; empty values add nothing."""
    values = F.filter(F.split(c, f"\\Q{delimiter}\\E", -1), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(values)))), delimiter)


def merge_values(df: DataFrame, key_col: str, value_col: str, delimiter: str = ",") -> DataFrame:
    """The union of the delimited sets of each key, in order of the keys. Tokens meet one by one, so a key with many rows
    is pre-aggregated token by token."""
    token = df.select(key_col, F.explode_outer(F.split(F.col(value_col), f"\\Q{delimiter}\\E", -1)).alias("t")).distinct()
    joined = F.array_join(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.col("t")))), delimiter)
    return token.groupBy(key_col).agg(joined.alias(value_col)).orderBy(key_col)


def _numbers(c: str | Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))


def summarize_experiment(x: dict[str, DigestResult], coldata: pd.DataFrame, countType: str = "umis") -> Experiment:
    """Combine digested samples; their order is that of x, and coldata is linked by `Name`."""
    if not isinstance(x, dict) or not x:
        raise TypeError("'x' must be a named list")
    if not isinstance(coldata, pd.DataFrame) or "Name" not in coldata.columns:
        raise ValueError("'coldata' needs a column 'Name'")
    assert_scalar(countType, "countType", "character", valid_values=["umis", "reads"])
    if countType == "umis" and not all("U" in r.parameters.get("elementsForward", "") + r.parameters.get("elementsReverse", "") for r in x.values()):
        raise ValueError("UMIs can't be counted: a sample was digested without any; use countType='reads'")
    delimiters = {r.parameters["mutNameDelimiter"] for r in x.values()}
    if len(delimiters) > 1:
        raise ValueError("the samples were digested with different values of 'mutNameDelimiter'")
    cols = coldata.assign(Name=coldata["Name"].astype(str))
    names = [n for n in x if n in set(cols["Name"])]
    if not names:
        raise ValueError("no sample of 'x' is named in the column 'Name' of 'coldata'")
    if len(names) < len(x):
        unused = [n for n in x if n not in names]
        warnings.warn(f"samples that 'coldata' doesn't name are left out: {', '.join(unused)}", stacklevel=2)
    tables = reduce(DataFrame.unionByName, [x[n].summaryTable.withColumn("sample", F.lit(n)) for n in names])
    rows = tables.groupBy("mutantName").agg(*(merged_set(c).alias(c) for c in MERGED))
    for c in NUMBERS:
        rows = rows.withColumn(c, F.array_join(F.array_sort(_numbers(F.col(c))).cast("array<string>"), ",")).withColumn("minN" + c[1:], F.array_min(_numbers(F.col(c)))).withColumn("maxN" + c[1:], F.array_max(_numbers(F.col(c))))
    count = "nbrUmis" if countType == "umis" else "nbrReads"
    assays = tables.select("mutantName", "sample", F.lit("counts").alias("assay"), F.col(count).cast("double").alias("value")).where("value <> 0")
    filters = pd.concat([x[n].filterSummary.toPandas().assign(Name=n) for n in names], ignore_index=True)
    cols = cols.drop_duplicates("Name").set_index("Name").loc[names].reset_index().merge(filters, on="Name", how="left")
    meta = {"parameters": {n: x[n].parameters for n in names}, "errorStatistics": {n: x[n].errorStatistics for n in names}, "countType": countType, "mutNameDelimiter": delimiters.pop()}
    return Experiment(assays, rows.orderBy("mutantName"), cols, meta)


def experiment_from_outcome(outcome: DataFrame, sample_col: str, col_data: pd.DataFrame, countType: str = "umis") -> Experiment:
    """An experiment of many samples in one pass: `outcome` holds the annotated reads of all, with their sample."""
    own = ["sequence", "n_bases", "n_codons", "n_aas", "base", "base_hgvs", "codon", "aa", "aa_hgvs", "sequence_aa", "lengths"]
    umi = ["umi"] if countType == "umis" else []
    kept = outcome.where("failure = ''").select(F.col("name").alias("mutantName"), F.col(sample_col).cast("string").alias("sample"), *umi, *own, F.array_join("types", ",").alias("types"))
    # alike reads are counted in one pass over the reads; all else reads the counts
    kept = scratch.cut(kept.groupBy(*kept.columns).agg(F.count("*").alias("n")))
    one = kept.where("umi <> ''").select("mutantName", "sample", "umi").distinct().withColumn("n", F.lit(1)) if umi else kept
    assays = one.groupBy("mutantName", "sample").agg(F.sum("n").cast("double").alias("value")).select("mutantName", "sample", F.lit("counts").alias("assay"), "value")
    kept = kept.select("mutantName", *own, "types").distinct()
    text = lambda c: F.array_join(F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")), ",")
    number = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",")
    rows = kept.groupBy("mutantName").agg(
        text("sequence").alias("sequence"),
        *(x for c, n in (("n_bases", "NbrMutBases"), ("n_codons", "NbrMutCodons"), ("n_aas", "NbrMutAAs")) for x in (number(c).alias("n" + n[1:]), F.min(c).alias("min" + n), F.max(c).alias("max" + n))),
        *(text(c).alias(n) for c, n in (("base", "mutantNameBase"), ("base_hgvs", "mutantNameBaseHGVS"), ("codon", "mutantNameCodon"), ("aa", "mutantNameAA"), ("aa_hgvs", "mutantNameAAHGVS"), ("sequence_aa", "sequenceAA"))),
        F.array_join(F.array_sort(F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("types", ",")))), lambda x: x != "")), ",").alias("mutationTypes"),
        text("lengths").alias("varLengths"),
    )
    return Experiment(assays, rows, col_data, {"countType": countType})


def collapse_mutants(se: Experiment, nameCol: str) -> Experiment:
    """Sum the counts of variants that share a value of a row annotation, and unite their annotations."""
    assert_scalar(nameCol, "nameCol", "character", valid_values=se.row_data.columns)
    key = se.row_data.select("mutantName", F.col(nameCol).alias("_key"))
    assays = se.assays.join(key, "mutantName").groupBy(F.col("_key").alias("mutantName"), "sample", "assay").agg(F.sum("value").alias("value"))
    strings = [f.name for f in se.row_data.schema.fields if f.dataType.simpleString() == "string" and f.name not in ("mutantName", nameCol)]
    low, high = ([c for c in se.row_data.columns if c.startswith(p)] for p in ("minNbrMut", "maxNbrMut"))
    aggs = [*(merged_set(c).alias(c) for c in strings), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high)]
    rows = se.row_data.groupBy(F.col(nameCol).alias("_key")).agg(*(aggs or [F.count("*").alias("nbrCollapsed")]))
    rows = rows.withColumnRenamed("_key", "mutantName")
    if nameCol != "mutantName":
        rows = rows.withColumn(nameCol, F.col("mutantName"))
    return Experiment(assays, rows.orderBy("mutantName"), se.col_data, se.metadata)


def collapse_mutants_by_aa(se: Experiment) -> Experiment:
    return collapse_mutants(se, "mutantNameAA")


def collapse_mutants_by_similarity(se: Experiment, assayName: str, scoreMethod: str = "rowSum", sequenceCol: str = "sequence", collapseMaxDist: float = 0, collapseMinScore: float = 0, collapseMinRatio: float = 0, verbose: bool = True) -> Experiment:
    """Collapse variants of similar sequences into the one of highest score (sum or mean over all samples)."""
    assert_scalar(scoreMethod, "scoreMethod", "character", valid_values=["rowSum", "rowMean"])
    assert_scalar(assayName, "assayName", "character", valid_values=se.assay_names())
    assert_scalar(sequenceCol, "sequenceCol", "character", valid_values=se.row_data.columns)
    for n, v in (("collapseMaxDist", collapseMaxDist), ("collapseMinScore", collapseMinScore), ("collapseMinRatio", collapseMinRatio)):
        assert_scalar(v, n, "numeric", rng_incl=(0, float("inf")))
    shape = se.row_data.agg(F.countDistinct(F.length(sequenceCol)).alias("k"), F.count_if(~F.col(sequenceCol).rlike("^[ACGT_]*$")).alias("bad")).collect()[0]
    if shape.k > 1:
        raise ValueError("the sequences to be grouped differ in length")
    if shape.bad:
        raise ValueError("The sequence column may only hold the letters A, C, G, T and _")
    total = F.sum("value") / F.lit(len(se.samples) if scoreMethod == "rowMean" else 1)
    score = se.assay(assayName).groupBy("mutantName").agg(total.alias("score"))
    scored = se.row_data.join(score, "mutantName", "left").select(F.col(sequenceCol).alias("sequence"), F.coalesce("score", F.lit(0.0)).alias("score"))
    groups = group_similar_sequences(scored, collapseMaxDist, collapseMinScore, collapseMinRatio)
    rows = se.row_data.join(groups.toDF(sequenceCol, "collapseCol"), sequenceCol, "left")
    return collapse_mutants(Experiment(se.assays, rows, se.col_data, se.metadata), "collapseCol")


def relabel_names(names: DataFrame, conversion: DataFrame, mutNameDelimiter: str = ".", col: str = "mutantName", out: str = "newName") -> DataFrame:
    """names with a column of names in which positions are replaced by (seqname, position) -> name; others stay."""
    part = F.posexplode(F.split(F.col(col), "_", -1)).alias("_i", "_p")
    d = f"\\Q{mutNameDelimiter}\\E"
    pieces = names.select(F.col(col).alias("_n"), part).withColumn("_s", F.split("_p", d, -1))
    table = conversion.select(F.col("seqname").alias("_seq"), F.col("position").cast("string").alias("_pos"), F.col("name").alias("_new")).groupBy("_seq", "_pos").agg(F.min("_new").alias("_new"))
    found = pieces.join(table, (F.get("_s", F.lit(0)) == F.col("_seq")) & (F.get("_s", F.lit(1)) == F.col("_pos")), "left")
    changed = F.array_join(F.concat(F.array(F.get("_s", F.lit(0)), F.col("_new")), F.slice("_s", 3, F.greatest(F.size("_s") - 2, F.lit(0)))), mutNameDelimiter)
    piece = F.when(F.col("_new").isNull(), F.col("_p")).otherwise(changed)
    new = found.groupBy("_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", piece.alias("x")))), lambda s: s.x), "_").alias(out))
    return names.join(new, F.col(col) == F.col("_n"), "left").drop("_n")


def relabel_mut_positions(se: Experiment, conversionTable: DataFrame, mutNameDelimiter: str = ".") -> Experiment:
    if not isinstance(se, Experiment):
        raise TypeError("'se' must be an Experiment")
    if conversionTable is None or not {"seqname", "position", "name"} <= set(getattr(conversionTable, "columns", ())):
        raise ValueError("'conversionTable' must have the columns seqname, position and name")
    assert_scalar(mutNameDelimiter, "mutNameDelimiter", "character")
    new = relabel_names(se.row_data.select("mutantName"), conversionTable, mutNameDelimiter)
    swap = lambda df: df.join(new, "mutantName").drop("mutantName").withColumnRenamed("newName", "mutantName").select(df.columns)
    return Experiment(swap(se.assays), swap(se.row_data), se.col_data, se.metadata)


def knee_ranks(assay: DataFrame) -> DataFrame:
    """Rank of each value within its sample, highest first; ties in order of the variant's name."""
    return ordered.running(assay, ["sample"], [F.desc("value"), F.col("mutantName")], F.lit(1), "idx")

