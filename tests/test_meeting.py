"""Pairs that meet in arrays: Hamming and edit distances of short strings, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from mavelake.operators import edits as E
from mavelake.operators import meeting as M
from mavelake.operators import neighbours as N
from mavelake.operators import similarity as S
from mavelake.operators.metric_index import MetricIndex

from .test_metric_index import column
from .test_neighbours import pairs_of, plain_umis
from .test_similarity import plain_levenshtein, plain_shift


def derived(spark, n, length):
    """Strings of a table whose size Spark knows."""
    return spark.range(n).selectExpr(f"substr(translate(md5(cast(id AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {length}) AS s")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, lengths, letters="ACG"):
    return sorted({"".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(n)})


def test_search_broadcasts_no_keys(spark):
    """A table of keys is many times the table that Spark takes its size from."""
    one, two = derived(spark, 300, 12), derived(spark, 100, 12)
    assert "Broadcast" not in plan(S.similarity_search(one, two, 3))
    long_, few = derived(spark, 60, 31), derived(spark, 30, 31)
    assert "BroadcastHashJoin" not in plan(S.similarity_search(long_, few, 3))


@pytest.mark.parametrize(("rows", "pairs"), [(1, 1), (7, 5), (1 << 16, 1 << 18)])
def test_buckets_in_pieces(spark, monkeypatch, rows, pairs):
    """Buckets that span batches, and more pairs than are compared at once; letters beyond ASCII too."""
    monkeypatch.setattr(M, "ROWS", rows)
    monkeypatch.setattr(M, "PAIRS", pairs)
    some = words(random.Random(3), 120, [2, 6, 9], "ACÄ€")
    df = column(spark, some)
    for d in (1, 3):
        got = N.hamming_pairs(df, df, d).collect()
        assert len(got) == len({(r.a, r.b) for r in got})
        assert {(r.a, r.b): r.dist for r in got} == pairs_of(some, d)


@pytest.mark.parametrize("keys", [20, 600])
@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_edits_of_several_lengths(spark, monkeypatch, d, keys):
    """Each pair once, also where one string is looked up by blocks and the other isn't."""
    monkeypatch.setattr(E, "KEYS", keys)
    rng = random.Random(d)
    one, two = words(rng, 60, [0, 1, 4, 5, 6, 7]), words(rng, 60, [2, 5, 6, 8])
    got = S.within(column(spark, one), column(spark, two), d, "levenshtein").collect()
    want = {(a, b): x for a in one for b in two if (x := plain_levenshtein(a, b)) <= d}
    assert len(got) == len(want) and {(r.a, r.b): r.dist for r in got} == want


def test_edit_keys_of_a_crowded_space(spark):
    """All strings of a bucket are within the distance, so there are hardly more candidates than pairs."""
    some = words(random.Random(1), 600, [6], "ACGT")
    df = column(spark, some)
    one, two = (E.edit_keys(df, 2, [0], x).withColumnRenamed("s", t) for x, t in ((True, "a"), (False, "b")))
    met = one.join(two, "key").select("a", "b")
    assert {(r.a, r.b) for r in met.distinct().collect()} == {(a, b) for a in some for b in some if plain_levenshtein(a, b) <= 2}


@pytest.mark.parametrize("keys", [20, 600])
def test_index_of_crowded_strings(spark, monkeypatch, keys):
    monkeypatch.setattr(E, "KEYS", keys)
    some = words(random.Random(2), 90, [4, 6, 7])
    index = MetricIndex.build(spark, column(spark, some[::2]), "levenshtein", 2).insert(column(spark, some[1::2])).remove(column(spark, some[:9]))
    found = index.search(column(spark, some), 2)
    got = found.collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == {(a, b, x) for a in some for b in some[9:] if (x := plain_levenshtein(a, b)) <= 2}
    hamming = MetricIndex.build(spark, derived(spark, 80, 10), "hamming", 2)
    assert "BroadcastHashJoin" not in plan(hamming.search(derived(spark, 50, 10), 2))


@pytest.mark.parametrize("few", [0, 1 << 15])
@pytest.mark.parametrize("metric", ["levenshtein", "hamming_shift"])
def test_nearest_of_short_strings(spark, monkeypatch, metric, few):
    """By keys alone and by comparing all; blocks, which nearly all short strings share, aren't asked."""
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "PER_KEY", few)
    monkeypatch.setattr(S, "BLOCK_LEFT", 7)
    monkeypatch.setattr(S, "BLOCK_RIGHT", 16)
    monkeypatch.setattr(S, "edit_pairs", None)
    monkeypatch.setattr(E, "KEYS", 5000)
    some = words(random.Random(4), 50, [7] if metric == "hamming_shift" else [5, 7, 8])
    far = {"levenshtein": plain_levenshtein, "hamming_shift": lambda a, b: plain_shift(a, b, -1)}[metric]
    df = spark.createDataFrame([*enumerate(some), (99, some[3])], "id int, s string")
    got = {r.id: r.dist for r in S.nearest_string_dist(df, metric).collect()}
    want = {i: min(far(a, b) for b in some if a != b) for i, a in enumerate(some)} | {3: 0, 99: 0}
    assert got == want
    if few:  # a longer string has no mismatches with the other
        alone = df.limit(1).union(df.where("id = 99").withColumn("s", F.lit("CCCCCCCCCCCCCC")))
        assert {r.dist for r in S.nearest_string_dist(alone, "hamming_shift").collect()} == {S.INT_MAX}


@pytest.mark.parametrize("compared", [-1, 300, 1 << 33])
@pytest.mark.parametrize(("alphabet", "length", "tolerance"), [("ACGT", [4, 5], 1), ("ACG", [17, 20], 9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", [3], 1), ("ACÄ€", [5], 2)])
def test_umis_in_one_pass(spark, monkeypatch, compared, alphabet, length, tolerance):
    """Groups in pieces, and what a task leaves of them for the edge table; alphabets of more letters than a word has room for."""
    monkeypatch.setattr(S, "COMPARED", compared)
    monkeypatch.setattr(S, "TOGETHER", 16)
    monkeypatch.setattr(S, "TILE", 3)
    rng = random.Random(tolerance)
    groups = {g: words(rng, n, length, alphabet) for g, n in (("wt", 150), ("a", 20), ("b", 1))}
    df = spark.createDataFrame([(g, u) for g, us in groups.items() for u in us], "mutantName string, umi string").repartition(3)
    got = {}
    for r in S.collapse_umis(df, tolerance, ["mutantName"]).collect():
        got.setdefault(r.mutantName, []).append(r.umi)
    assert {g: sorted(u) for g, u in got.items()} == {g: plain_umis(us, tolerance) for g, us in groups.items()}


def test_crowded_umis_make_no_edges(spark, monkeypatch):
    """Each of 4,096 UMIs has hundreds of near ones: they are gone through without a table of near pairs."""
    monkeypatch.setattr(S, "settle", None)
    df = spark.createDataFrame([("".join("ACGT"[i >> 2 * p & 3] for p in range(6)),) for i in range(4096)], "umi string").selectExpr("'x' AS mutantName", "umi")
    kept = sorted(r.umi for r in S.collapse_umis(df, 3, ["mutantName"]).collect())
    assert kept == plain_umis([r.umi for r in df.collect()], 3)
