"""The pipeline's stages, each held against what its operator decides, and edge cases."""

import pytest

import corpus_pipeline as P
from mavelake.llm import decontaminate, linededup, neardup
from mavelake.llm.common import cut, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in P.STAGES:
        before = docs
        docs = cut(stage(spark, docs, sf_dir), "test")
        kept[name] = docs.count()
        if name != "bpe":
            assert docs.columns == P.COLUMNS
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in docs.collect()} == {r.doc_id: r.text for r in linededup.drop_lines(before).collect()}
        if name == "near_dedup":
            firsts = {r.class_id for r in neardup.classes(before).collect()}
            assert {r.doc_id for r in docs.collect()} == firsts
        if name == "decontamination":
            assert decontaminate.digests(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").count() == 0
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    assert docs.join(labels, "doc_id").count() <= 0.05 * labels.count()
    assert kept["quality"] > 0.7 * table(spark, sf_dir, "documents").count() and kept["line_dedup"] == kept["quality"] and kept["bpe"] == kept["decontamination"]


def test_run_columns(spark, sf_dir):
    assert P.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("stage", P.STAGES, ids=[n for n, _ in P.STAGES])
def test_edges(spark, sf_dir, stage):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", None, 5), (3, "word " * 30000, "en", "s", 150000), (3, "word " * 30000, "en", "s", 150000)]
    df = spark.createDataFrame([(*r, "more", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, class string, n_words int")
    assert stage[1](spark, df, sf_dir).count() <= 5
    assert stage[1](spark, df.limit(0), sf_dir).count() == 0
