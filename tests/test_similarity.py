import numpy as np
import pytest

from mavelake.functions import genetics as g
from mavelake.functions import special
from mavelake.operators import experiment as X
from mavelake.operators import similarity as S
from mavelake.plans import ordered
from pyspark.sql import functions as F

def words(rng, n, length, letters="ACGT"):
    return ["".join(rng.choice(list(letters), length)) for _ in range(n)]


def plain_groups(scores, dist, least, ratio):
    """Greedy grouping, one sequence after the other."""
    order = sorted(scores, key=lambda s: (-scores[s], s))
    taken = {}
    for q in order:
        if q in taken:
            continue
        taken[q] = q
        if scores[q] < least:
            continue
        for t in order:
            if t not in taken and sum(a != b for a, b in zip(q, t, strict=True)) <= dist and scores[q] >= ratio * scores[t]:
                taken[t] = q
    return taken


@pytest.mark.parametrize("dist,least,ratio", [(1, 0, 0), (0, 0, 0), (2, 0, 1.5), (1, 6, 2), (8, 3, 1), (3, 0, 4)])
def test_groups_like_plain_greedy(spark, dist, least, ratio):
    rng = np.random.default_rng(17)
    scores = {s: float(rng.integers(1, 12)) for s in words(rng, 90, 6, "ACG")}
    df = spark.createDataFrame(list(scores.items()), "sequence string, score double")
    got = {r.sequence: r.representative for r in S.group_similar_sequences(df, dist, least, ratio).collect()}
    assert got == plain_groups(scores, dist, least, ratio)


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_shift(a, b, most):
    """Least of mismatches in the overlap plus two for each base of the shift, and at most the length; most < 0: any shift."""
    n = len(a)
    best = n
    for s in range(-(n - 1), n):
        if most < 0 or abs(s) <= most:
            x, y = (a[s:], b[: n - s]) if s >= 0 else (a[: n + s], b[-s:])
            best = min(best, 2 * abs(s) + sum(p != q for p, q in zip(x, y, strict=True)))
    return best


def test_distances(spark):
    rng = np.random.default_rng(5)
    pairs = list(zip(words(rng, 60, 9, "AC"), words(rng, 60, 9, "AC"), strict=True))
    pairs += [(a, a[k:] + a[:k]) for k, a in enumerate(words(rng, 8, 9))]
    shifts = [0, 1, 2, 3, -1]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", g.hamming(a, b).alias("h"), g.levenshtein(a, b).alias("l"), *(g.hamming_shift(a, b, k).alias(f"s{k}") for k in shifts)).collect():
        assert r.h == sum(x != y for x, y in zip(r.a, r.b, strict=True)) and r.l == plain_levenshtein(r.a, r.b)
        assert [r[f"s{k}"] for k in shifts] == [plain_shift(r.a, r.b, k) for k in shifts]


@pytest.mark.parametrize("metric", ["hamming", "levenshtein", "hamming_shift"])
def test_nearest(spark, metric):
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACGT"), 8)) for _ in range(40)] + ["ACGTACGT"] * 2
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    got = {r.id: r.dist for r in S.nearest_string_dist(df, metric).collect()}
    f = {"hamming": g.hamming, "levenshtein": g.levenshtein, "hamming_shift": g.hamming_shift}[metric]
    both = df.crossJoin(df.toDF("j", "t")).where("id <> j").groupBy("id").agg(F.min(f(F.col("s"), F.col("t"))).alias("d"))
    assert got == {r.id: r.d for r in both.collect()}
    assert S.nearest_string_dist(df.limit(1), metric).first().dist == S.INT_MAX
    with pytest.raises(ValueError):
        S.nearest_string_dist(df, "cosine")


def test_search(spark):
    rng = np.random.default_rng(4)
    seqs = ["".join(rng.choice(list("AC"), 10)) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = {(r.query, r.match) for r in S.similarity_search(df, df, 2).collect()}
    assert got == {(a, b) for a in seqs for b in seqs if sum(x != y for x, y in zip(a, b, strict=True)) <= 2}
    some = [*seqs[:25], "", "A", "CA", "ACACACACACAC", *(x[:k] + x[k + 1 :] for k, x in enumerate(seqs[:9]))]
    of = spark.createDataFrame([(x,) for x in some], "s string")
    for tol in (0, 1, 2):
        got = {(r.query, r.match) for r in S.similarity_search(df, of, tol, "levenshtein").collect()}
        assert got == {(a, b) for a in some for b in seqs if plain_levenshtein(a, b) <= tol}
    got = {(r.query, r.match) for r in S.similarity_search(df, df, 3, "hamming_shift").collect()}
    assert got == {(a, b) for a in seqs for b in seqs if plain_shift(a, b, -1) <= 3}


def test_merge_values(spark):
    rng = np.random.default_rng(8)
    rows = [(str(rng.integers(6)), ",".join(str(x) for x in rng.integers(0, 9, rng.integers(0, 4)))) for _ in range(40)] + [("none", "")]
    want = {}
    for k, v in rows:
        want.setdefault(k, set()).update(x for x in v.split(",") if x)
    got = {r.k: r.v for r in X.merge_values(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items()}


def test_relabel(spark):
    rng = np.random.default_rng(9)
    table = {(s, str(p)): f"{s}{100 + p}" for s in ("left", "rt") for p in range(0, 9, 2)}
    part = lambda: (str(rng.choice(["left", "rt", "other"])), str(rng.integers(9)), "".join(rng.choice(list("ACGT"), 3)))
    names = [[part() for _ in range(rng.integers(1, 4))] for _ in range(50)] + [[("left", "0", "WT")], [("other", "0", "WT")]]
    written = lambda ps: "_".join(".".join(p) for p in ps)
    want = {written(ps): written([(s, table.get((s, at), at), x) for s, at, x in ps]) for ps in names}
    n = spark.createDataFrame([(x,) for x in want], "mutantName string")
    conv = spark.createDataFrame([(*k, v) for k, v in table.items()], "seqname string, position string, name string")
    assert {r.mutantName: r.newName for r in X.relabel_names(n, conv).collect()} == want


def test_translate_columns(spark):
    codons = list(g.CODE)
    df = spark.createDataFrame([("_".join(codons), "_".join(g.CODE.values())), ("".join(codons).lower().replace("t", "u"), "".join(g.CODE.values())), ("AAN,AAA.A", "XXX"), ("", "")], "s string, p string")
    assert all(r.p == r.t for r in df.select("p", g.translate(F.col("s")).alias("t")).collect())
    with pytest.raises(Exception, match="ACGTN"):
        spark.createDataFrame([("AXC",)], "s string").select(g.reverse_complement(F.col("s"))).collect()


def test_special_functions():
    assert np.isclose(special.t_two_sided(2.228138852, 10), 0.05, atol=1e-8)
    assert np.isclose(special.f_upper(4.964602744, 1, 10), 0.05, atol=1e-8)
    assert np.isclose(special.digamma(1.0), -0.5772156649015329) and np.isclose(special.trigamma(1.0), np.pi**2 / 6)
    assert np.isclose(special.trigamma(special.trigamma_inverse(0.7)), 0.7) and np.isclose(special.gammaln(5.5), 3.957813967618717)
    assert np.isclose(special.t_quantile(0.975, np.array(10.0)), 2.228138852)
    x = np.linspace(0, 1, 50)
    assert np.allclose(special.lowess(x, 2 * x + 1), 2 * x + 1)


def test_running_over_ranges(spark):
    """Running sums and minima, by group and over all, as one pass over sorted rows has them."""
    rng = np.random.default_rng(21)
    rows = [(str(rng.integers(3)), int(x), int(rng.integers(-5, 9))) for x in rng.permutation(200)]
    df = spark.createDataFrame(rows, "g string, x int, v int").repartition(5)
    for group in ([], ["g"]):
        up = ordered.running(df, group, [F.col("x")], F.col("v"), "r")
        down = ordered.running(df, group, [F.desc("x")], F.col("v"), "r", F.min)
        for got, back, of in ((up, False, sum), (down, True, min)):
            for r in got.collect():
                seen = [v for g, x, v in rows if (not group or g == r.g) and (x >= r.x if back else x <= r.x)]
                assert r.r == of(seen)
