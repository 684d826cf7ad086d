"""BPE, decontamination, line dedup, quality: against the tokenizers library, brute force, SQL and held-out labels."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mavelake.llm import bpe, decontaminate, linededup, quality
from mavelake.llm.common import table
from mavelake.llm.queries import tokenizer_path

from ..helpers import same

MODEL = tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files here")
ODD = ["", None, "<|endoftext|>", "a<|endoftext|> b  \n\n c's aaaa aaaaaaa 日本語 ​ é ½ ²③ \U0001f600\U0001f600   ", "the  'S 'll \t\r\n", "\u0085  x", "ǅ٣४", " a b", "a b ", "a\nb \nc", "x\n y", "a\x1c b", " ", "word " * 5000, "z" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def engine():
    with open(MODEL, "rb") as f:
        return bpe.ByteBpe(f.read())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_bpe_like_library(spark, library):
    rows = [(i, t, "extra", [7]) for i, t in enumerate(ODD)] + [(1, ODD[4], "again", [8]), (None, "no id", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = sorted(map(tuple, bpe.round_trip(df, MODEL).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    both = bpe.decode(bpe.encode(df, MODEL), MODEL)
    assert both.columns == ["doc_id", "text", "ids", "decoded"] and all(r.decoded == (r.text or "") for r in both.collect())
    assert bpe.round_trip(df.limit(0), MODEL).count() == 0
    with pytest.raises(Exception, match="lacks"):
        bpe.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>"), MODEL).collect()


def test_bpe_long_texts(spark, library, monkeypatch):
    """Texts that are cut into parts, at places between tokens only."""
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "naïve", "don't", "<|endoftext|>", "  x", "\n", "日本", "a1b2", " "])
    texts = [" ".join(word() for _ in range(rng.randrange(400))) for _ in range(30)]
    for t in texts:
        cut = list(bpe.parts(t, 50))
        assert "".join(cut) == t
        assert [i for x in cut for i in library.encode(x, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "PART", 60)
    with open(MODEL, "rb") as f:
        model = bpe.ByteBpe(f.read(), cache_bytes=10_000)
    for at, ids, counts in bpe._encoded(model, pa.array(texts, pa.string())):
        got = {r: [] for r in at}
        for r, x in zip(at, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            got[r] += x.tolist()
        assert all(got[r] == library.encode(texts[r], add_special_tokens=False).ids for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_bpe_any_text(engine, library, texts):
    ids, n = engine.encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert engine.decode(ids, n) == texts


def test_bpe_chunks_are_split_together(library, monkeypatch):
    """New chunks between lone spaces are pre-tokenized as one text; only first chunks and odd texts go one by one."""
    with open(MODEL, "rb") as f:
        model = bpe.ByteBpe(f.read(), cache_bytes=10_000)
    calls, split = [], model.split
    monkeypatch.setattr(model, "split", lambda t: calls.append(t) or split(t))
    rng = random.Random(3)
    parts = ["the", "don't", "'s", "été", "1984,", "x\ny", "日本語", "(a)", "²", "😀"]
    for _ in range(4):  # the caches of ten kilobytes are dropped meanwhile
        texts = ["", *("the " + " ".join(rng.choice(parts) + rng.choice(parts) + str(rng.randrange(99)) for _ in range(60)) for _ in range(20))]
        calls.clear()
        ids, n = model.encode(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(calls) <= 3  # one for all chunks; the first chunks are "" and "the"


def test_bpe_merge_order(engine, library):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab ing the") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    ids, n = engine.encode(pa.array(words))
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def fold(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_hits(text, items, window=10):
    w, mask, found = fold(text), None, set()
    mask = [False] * len(w)
    for name, t in items:
        ws = fold(t)
        if name is None or not ws:
            continue
        n = min(window, len(ws))
        grams = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                found.add(str(name))
                mask[i : i + n] = [True] * n
    return len(w), sum(mask), len(found), sha(",".join(sorted(found))), any(mask)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "C", "d", "é", "7"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 16)))) for i in range(12)] + [(12, None), (13, " .. "), (None, "a b"), (3, "a b c d")]
    docs = [(i, " ".join(word() + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(0, 120))), "s", 1) for i in range(40)] + [(40, None, "s", 1), (41, "", "s", 1), (5, "b a", "s", 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(d, i, keep=["doc_id"], block_bytes=block)
    rows = {(r.doc_id, r.n_words, tuple(r.hit_spans), tuple(r.hit_items)) for r in found.collect()}
    for doc_id, n_words, spans, names in rows:
        texts = [t for j, t, *_ in docs if j == doc_id and len(fold(t)) == n_words]
        n, hit, k, digest, _ = brute_hits(texts[0], items)
        assert (sum(b - a for a, b in zip(spans[::2], spans[1::2], strict=True)), len(names), sha(",".join(names))) == (hit, k, digest)
    same(decontaminate.digests(d, i).toPandas(), pd.DataFrame([(j, *brute_hits(t, items)) for j, t, *_ in docs], columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]))
    assert decontaminate.digests(d, i.limit(0)).where("contaminated").count() == 0 and decontaminate.digests(d.limit(0), i).count() == 0


def test_decontamination_sql(spark, duck, sf_dir):
    same(decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).toPandas(), duck.sql(decontaminate.ORACLE_SQL).df())


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_cuts(spark, block):
    passage = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"Start {'x ' * 20}. {passage.upper()}! End."), (2, passage), (3, "clean text"), (4, None)], "doc_id long, text string")
    i = spark.createDataFrame([(1, passage), (2, "other " * 12)], "item_id long, text string")
    d = d.selectExpr("77 AS n_words", "'own' AS hit_items", "*", "1 AS hit_spans")
    out = decontaminate.clean(d, i, block_bytes=block)
    assert out.schema.names == d.schema.names and all((r.n_words, r.hit_items, r.hit_spans) == (77, "own", 1) for r in out.collect())
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: f"Start {'x ' * 20}. ! End.", 3: "clean text", 4: None}


def test_line_dedup(spark, duck, sf_dir):
    same(linededup.digests(table(spark, sf_dir, "documents")).toPandas(), duck.sql(linededup.ORACLE_SQL).df())
    rows = [(i, f"menu\nline {i}\n\n menu \nmenu", "h1", "k") for i in range(10)] + [(20 + i, f"menu\nother {i}", "h2", "k") for i in range(3)] + [(30, None, "h1", "k"), (31, "", None, "k"), (32, "menu", None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")
    out = linededup.drop_lines(df, dropped_col="gone")
    got = {r.doc_id: (r.text, r.gone) for r in out.collect()}
    assert out.columns[:4] == df.columns and got[0] == ("line 0\n", 3) and got[20] == ("menu\nother 0", 0) and got[30] == (None, 0) and got[31] == ("", 0) and got[32] == ("menu", 0)
    assert linededup.drop_lines(df.limit(0)).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1" if os.path.exists("/root/testdata/sf0.1") else "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train = labels.where("doc_id % 2 = 0")
    model = quality.train(docs, train, quality.grade_of_labels(), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = (got.quality == 1) & (got.toxic == 0)
    chosen = got.p_top >= 0.5
    assert chosen[clean].mean() > 0.98 and chosen[~clean].mean() < 0.1
    means = got.groupby(np.where(got.toxic == 1, 0, np.where(got.quality == 0, 1, 2))).expected_grade.mean()
    assert means[2] > max(means[0], means[1])


def plain_loss(theta, w, x, grades, l2):
    """Mean negative log-likelihood of a cumulative-link model, from its definition; theta: weights, first threshold, log steps."""
    t = np.cumsum(np.concatenate([theta[w : w + 1], np.exp(theta[w + 1 :])]))
    total = 0.0
    for row, g in zip(x, grades, strict=True):
        above = [1.0, *(1 / (1 + math.exp(-(row @ theta[:w] - k))) for k in t), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(grades) + l2 / 2 * float(theta[:w] @ theta[:w])


def test_quality_fit_is_a_minimum():
    """The fit against the plain likelihood: no small step makes it better, and a plain descent from zero ends at its loss."""
    rng = np.random.default_rng(12)
    n, w = 240, 6
    x = (rng.random((n, w)) < 0.4).astype(float)
    grades = np.digitize(x @ np.array([2.0, -1.5, 1.0, 0, 0.5, -1]) + rng.logistic(size=n), [-0.5, 1.0])
    row, flat = np.nonzero(x)
    model = quality.fit(flat, row, grades, 3, 11, steps=3000, rate=0.02, l2=0.01)
    assert (np.diff(model.thresholds) > 0).all() and not model.weights[w:].any()
    theta = np.concatenate([model.weights[:w], model.thresholds[:1], np.log(np.diff(model.thresholds))])
    loss = lambda v: plain_loss(v, w, x, grades, 0.01)
    slope = lambda v: np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in 1e-5 * np.eye(len(v))])
    assert np.abs(slope(theta)).max() < 2e-3
    plain = np.concatenate([np.zeros(w), [-1.0, 0.0]])
    for _ in range(400):
        plain -= 1.5 * slope(plain)
    assert abs(loss(plain) - loss(theta)) < 1e-3
    p = model.tails(x @ model.weights[:w])
    assert (np.diff(p, axis=1) <= 0).all()


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 30000, 0.5), (None, "y", 0.5), (2, "", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(d, none, quality.grade_of_labels(), 3)
    rows = quality.score(d, model).collect()
    assert len(rows) == 5 and all(abs(r.p_top - 1 / 3) < 1e-9 and abs(r.expected_grade - 1) < 1e-9 for r in rows)
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(d, quality.train(d, some, quality.grade_of_labels(), 3)).count() == 5
