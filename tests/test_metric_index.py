"""The updatable index against a plain list with the same rules."""

import random

import pytest

from mavelake.operators.metric_index import MetricIndex

from .test_neighbours import codon_variants
from .test_similarity import plain_levenshtein, plain_shift


def plain_metric(name):
    def hamming(a, b):
        return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else None

    return {"hamming": hamming, "levenshtein": plain_levenshtein, "hamming_shift": lambda a, b: plain_shift(a, b, len(a))}[name]


class Plain:
    """Strings in the order of insertion; removed ones are remembered until they are at least half of what is left."""

    def __init__(self, metric):
        self.metric, self.items, self.deleted = metric, [], set()

    def insert(self, strings):
        for s in sorted(set(strings)):
            if s in self.items:
                self.deleted.discard(s)
            else:
                self.items.append(s)

    def remove(self, strings):
        self.deleted |= set(strings) & set(self.items)
        if len(self.deleted) >= (len(self.items) - len(self.deleted)) // 2:
            self.items, self.deleted = self.all(), set()

    def all(self):
        return [s for s in self.items if s not in self.deleted]

    def search(self, queries, tol):
        return {(q, s, d) for q in set(queries) for s in self.all() if (d := self.metric(q, s)) is not None and d <= tol}


def column(spark, strings):
    return spark.createDataFrame([(s,) for s in strings], "s string")


def agree(spark, index, plain, queries, tols):
    assert [r.s for r in index.all().orderBy("at").collect()] == plain.all()
    assert index.size == len(plain.all())
    assert index.removed == len(plain.deleted)
    assert index.first() == next(iter(plain.all()), None)
    for tol in tols:
        want = plain.search(queries, tol)
        got = index.search(column(spark, queries), tol).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == want
        has = {r.query: r.found for r in index.has(column(spark, queries), tol).collect()}
        assert has == {q: any(q == x for x, _, _ in want) for q in queries}


@pytest.mark.parametrize(("metric", "radius"), [("hamming", 2), ("levenshtein", 1), ("hamming_shift", 2)])
def test_changes(spark, metric, radius):
    """Batches in and out, repeats, strings that come back before and after a merge, several lengths, the empty string."""
    rng = random.Random(radius)
    lengths = [8] if metric == "hamming_shift" else [0, 3, 8]
    word = lambda: "".join(rng.choices("ACG", k=rng.choice(lengths)))
    pool = sorted({word() for _ in range(60)})
    plain, index = Plain(plain_metric(metric)), MetricIndex.build(spark, metric=metric, radius=radius)
    queries = rng.sample(pool, 8)
    agree(spark, index, plain, queries, [])
    for step, size in enumerate([40, -6, 12, 4, -3, -30, 10]):
        some = rng.choices(pool, k=abs(size))
        (plain.insert if size > 0 else plain.remove)(some)
        index = (index.insert if size > 0 else index.remove)(column(spark, some))
        agree(spark, index, plain, queries, [[], [radius], [radius + 1], [], [0], [], [radius]][step])
    assert len(index.segments) <= 3
    index = index.remove(index.all())
    assert (index.size, index.first(), index.search(column(spark, pool), 3).count()) == (0, None, 0)


def test_old_versions_stay(spark):
    one = MetricIndex.build(spark, column(spark, ["AAAA", "AAAC", "CCCC", "GGGG", "TTTT"]))
    two = one.remove(column(spark, ["AAAA"]))
    three = two.insert(column(spark, ["AAAA", "AATT"]))
    found = lambda i: {r.match for r in i.search(column(spark, ["AAAA"]), 1).collect()}
    assert [found(i) for i in (one, two, three)] == [{"AAAA", "AAAC"}, {"AAAC"}, {"AAAA", "AAAC"}]
    assert (two.removed, three.removed, three.remove_all().size) == (1, 0, 0)
    assert three.first() == "AAAA"  # it came back to its old place


def test_nulls_and_order(spark):
    df = spark.createDataFrame([("C", 3), (None, 1), ("A", 5), ("C", 9), ("G", 2)], "s string, k int")
    index = MetricIndex.build(spark, df, order=["k"])
    assert [r.s for r in index.all().orderBy("at").collect()] == ["G", "C", "A"]
    assert {tuple(r) for r in index.has(spark.createDataFrame([("A",), (None,), ("T",)], "s string")).collect()} == {("A", True), (None, None), ("T", False)}
    assert index.search(spark.createDataFrame([(None,)], "s string"), 1).count() == 0
    with pytest.raises(ValueError, match="unknown distance"):
        MetricIndex.build(spark, df, metric="other")
    with pytest.raises(ValueError, match="negative"):
        MetricIndex.build(spark, df, radius=-1)


def test_library_of_one_parent(spark):
    """Variants of one sequence and strings far from it that share half of it, against a plain scan."""
    rng = random.Random(5)
    parent = "".join(rng.choices("ACGT", k=30))
    words = codon_variants(parent)
    far = [parent[:15] + "".join(rng.choices("ACGT", k=15)) for _ in range(30)]
    far += [s[:20] + "A" + s[21:] for s in far]
    plain = Plain(plain_metric("hamming"))
    plain.insert(words)
    plain.insert(far[:40])
    plain.remove(words[:50])
    index = MetricIndex.build(spark, column(spark, words), radius=2).insert(column(spark, far[:40])).remove(column(spark, words[:50]))
    queries = sorted({*rng.sample(words, 20), *far})
    got = {tuple(r) for r in index.search(column(spark, queries), 2).collect()}
    assert got == plain.search(queries, 2)
