"""Hamming pairs, UMIs and groups on libraries made from one sequence, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mavelake.operators import neighbours as N
from mavelake.operators import similarity as S

from .test_similarity import plain_groups


def differing(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def pairs_of(words, d):
    return {(a, b): differing(a, b) for a in words for b in words if len(a) == len(b) and differing(a, b) <= d}


def codon_variants(parent):
    """All variants of one codon."""
    codons = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    return sorted({parent[:i] + c + parent[i + 3 :] for i in range(0, len(parent), 3) for c in codons})


def mixed(rng):
    """A parent of 30 bases, variants with few and many changes, and clusters of changes."""
    parent = "".join(rng.choices("ACGT", k=30))
    out = {parent}
    for _ in range(60):
        s = list(parent)
        for i in rng.sample(range(30), rng.choice([1, 2, 3, 4, 8, 14, 25])):
            s[i] = rng.choice("ACGT")
        out.add("".join(s))
    for _ in range(25):
        s = list(parent)
        a = rng.randrange(20)
        s[a : a + 10] = rng.choices("ACGT", k=10)
        out.add("".join(s))
        s[rng.randrange(30)] = "A"
        out.add("".join(s))
    return sorted(out)


@pytest.mark.parametrize("d", [1, 2, 4, 11])
def test_pairs_near_and_far_from_a_parent(spark, d):
    words = mixed(random.Random(d))
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = N.hamming_pairs(df, df, d).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.dist for r in got} == pairs_of(words, d)


@pytest.mark.parametrize("d", [0, 1, 3, 7, 20])
def test_pairs_of_short_strings_of_several_lengths(spark, d):
    rng = random.Random(d)
    words = sorted({"".join(rng.choices("ACG", k=rng.choice([0, 1, 7, 12]))) for _ in range(90)})
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert {(r.a, r.b): r.dist for r in N.hamming_pairs(df, df, d).collect()} == pairs_of(words, d)


def test_pairs_of_two_tables_and_groups(spark):
    rng = random.Random(1)
    words = mixed(rng)
    one = spark.createDataFrame([(w, i % 2) for i, w in enumerate(words)], "s string, g int")
    two = spark.createDataFrame([(w, g) for w in words[::3] for g in (0, 1)], "s string, g int")
    got = {(r.g, r.a, r.b) for r in N.hamming_pairs(one, two, 2, by=["g"]).collect()}
    assert got == {(i % 2, a, b) for i, a in enumerate(words) for b in words[::3] if differing(a, b) <= 2}
    empty = one.where("false")
    assert N.hamming_pairs(empty, two, 2).count() == N.hamming_pairs(empty, empty, 2).count() == 0


def test_few_candidates_in_a_library_of_one_parent(spark):
    """All variants of one codon of a parent of 96 bases: strings meet hardly more often than they are near."""
    parent = "".join(random.Random(7).choices("ACGT", k=96))
    words = codon_variants(parent)
    df = spark.createDataFrame([(w,) for w in words], "s string")
    letters = np.array([list(w.encode()) for w in words])
    for d in (1, 2):
        near = sum(int(((letters != row).sum(1) <= d).sum()) for row in letters)
        assert N.hamming_pairs(df, df, d, parent).count() == near
        assert N.candidates(df, df, d).count() <= 2 * near


@pytest.fixture(params=[0, 40, 1 << 18])
def tail(request, monkeypatch):
    """By rounds alone, rounds with an end in order, and in order alone."""
    monkeypatch.setattr(S, "TAIL", request.param)


def plain_umis(umis, tolerance):
    kept = []
    for u in sorted(umis):
        if not any(len(k) == len(u) and differing(k, u) <= tolerance for k in kept):
            kept.append(u)
    return kept


@pytest.mark.parametrize("tolerance", [0, 1, 3, 6])
def test_umis_in_rounds(spark, tail, tolerance):
    """A large and small groups, several lengths, repeated rows."""
    rng = random.Random(tolerance)
    groups = {"wt": 300, "a": 12, "b": 1}
    rows = [(g, "".join(rng.choices("ACGT", k=rng.choice([5, 6])))) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(rows + rows[:5], "mutantName string, umi string")
    got = {}
    for r in S.collapse_umis(df, tolerance, ["mutantName"]).collect():
        got.setdefault(r.mutantName, []).append(r.umi)
    assert {g: sorted(u) for g, u in got.items()} == {g: plain_umis({u for h, u in rows if h == g}, tolerance) for g in groups}


def test_long_chain_of_umis(spark, tail):
    """Each UMI is near the next only: every second one is kept."""
    umis = ["T" * i + "A" * (12 - i) for i in range(13)]
    df = spark.createDataFrame([("x", u) for u in umis], "mutantName string, umi string")
    assert sorted(r.umi for r in S.collapse_umis(df, 1, ["mutantName"]).collect()) == plain_umis(umis, 1) == umis[::2]


@pytest.mark.parametrize("dist,least,ratio", [(2, 0, 1), (1, 4, 2), (500, 0, 0), (500, 3, 1.5), (500, 99, 0)])
def test_groups_of_variants(spark, dist, least, ratio):
    rng = random.Random(5)
    scores = {w: float(rng.randrange(1, 12)) for w in codon_variants("ATGGCTAAG")[::4] + mixed(rng)[:0]}
    df = spark.createDataFrame(list(scores.items()), "sequence string, score double")
    got = {r.sequence: r.representative for r in S.group_similar_sequences(df, dist, least, ratio, parent="ATGGCTAAG").collect()}
    assert got == plain_groups(scores, dist, least, ratio)


def test_no_key_of_a_parent(spark):
    """The share of the commonest key among those of a library: none but that of the strings that are all near each other."""
    words = codon_variants("".join(random.Random(7).choices("ACGT", k=96)))
    df = spark.createDataFrame([(w,) for w in words], "s string")
    keys = N.Keys(1, {96: words[0]})
    keyed = N._keyed(df, N.Keys(1, N.consensus(df, [])), True, set(), [])
    assert keyed.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 1 + 96 * 3 and keys.most > 3
