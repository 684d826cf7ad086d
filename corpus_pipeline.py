"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents but
for the last, which returns the digests of the token ids and of the decoded text. Between stages the documents are written
as Parquet in the shared folder and read again.

Defined cases are those of the operators; a document whose boilerplate lines are all it has stays with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mavelake.llm import bpe, decontaminate, linededup, neardup, quality
from mavelake.llm.common import cut, table
from mavelake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars counted anew."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least a half; grades are learned from all of `labels`."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.grade_of_labels(), 3)
    return quality.score(docs, model).where(F.col("p_top") >= 0.5).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(linededup.drop_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Neither the classifier nor the sampling of similar texts has an SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
