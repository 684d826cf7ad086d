"""An updatable index of strings under a distance: search, membership, first, all, insertion and removal.

The index is a set of tables in the shared folder, and every change gives a new version; older ones stay valid:

* items: each string with its number in the order of insertion;
* segments: the keys under which strings are looked up, one table per batch of insertions. A segment that is at least half as
  large as the one before is merged with it, so there are no more than about log2 of the items;
* tombstones: removed strings, which stay in the segments and are taken out of every answer. As soon as there are at least half
  as many of them as strings that are left, the segments are written anew without them.

A search is an equi-join of the queries' keys with the segments' and never writes the keys of the items again. A key is what
two strings within `radius` share (see `neighbours`, `edits` and `similarity.edit_pairs`); candidates are verified, so answers are
exact. Beyond the radius the items are searched without keys. Short strings of another length than a query's have no keys for edit
distances in the segments; a search makes them, for the lengths that need them.

Defined cases: null strings are no items and match nothing; repeated strings count once, at their first number; the empty
string is an item like others; inserting what is there, and removing what isn't, changes nothing. A removed string that comes
back before its tombstone is merged away has its old place in the order, otherwise the last one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ordered
from ..plans.scratch import cut
from . import similarity
from .edits import edit_keys, edit_near, lengths_of, reach
from .neighbours import BLOCKS, MASKED, NEAR, PARTS, PLACES, Keys, consensus, _keyed, short_keys, short_pairs

#: The kind of the keys of short strings, by which pairs meet in arrays.
SHORT = -1
KINDS = {NEAR, PARTS, PLACES, BLOCKS}


@dataclass(frozen=True)
class Segment:
    keys: DataFrame
    strings: int


@dataclass(frozen=True)
class MetricIndex:
    """One version of an index. `parents` has a string for each length, for the keys of the Hamming distance."""

    metric: str
    radius: int
    items: DataFrame
    tombstones: DataFrame
    segments: tuple[Segment, ...]
    parents: tuple[tuple[int, str], ...]
    size: int
    removed: int
    last: int

    @classmethod
    def build(cls, spark: SparkSession, strings: DataFrame | None = None, metric: str = "hamming", radius: int = 1, col: str = "s", order: list[str] | None = None) -> MetricIndex:
        """An index of the strings of a column, numbered in the order of the columns `order` (the string itself if None)."""
        similarity.metric(metric)
        if radius < 0:
            raise ValueError("the radius of an index can't be negative")
        empty = spark.createDataFrame([], "s string, at long")
        out = cls(metric, int(radius), empty, empty.select("s"), (), (), 0, 0, 0)
        return out if strings is None else out.insert(strings, col, order)

    # -- answers

    def all(self) -> DataFrame:
        """(s, at): what is in the index; `at` grows in the order of insertion."""
        return self.items.join(self.tombstones, "s", "left_anti") if self.removed else self.items

    def first(self) -> str | None:
        """The string that is in the index for longest."""
        row = self.all().agg(F.min(F.struct("at", "s")).alias("f")).collect()[0].f
        return row and row.s

    def search(self, queries: DataFrame, tol: int, col: str = "s") -> DataFrame:
        """(query, match, dist): all strings of the index within tol of each distinct query."""
        asked = queries.where(F.col(col).isNotNull()).select(F.col(col).alias("s")).distinct()
        if tol < 0 or not self.segments:
            return asked.where("false").select(F.col("s").alias("query"), F.col("s").alias("match"), F.lit(0).alias("dist"))
        if tol > self.radius:
            return similarity.similarity_search(self.all(), asked, tol, self.metric)
        keys = reduce(DataFrame.unionByName, (x.keys for x in self.segments))
        near = reduce(DataFrame.union, self._near(asked, keys)).where(F.col("dist") <= tol)
        return near.join(self.tombstones.withColumnRenamed("s", "match"), "match", "left_anti").select("query", "match", "dist") if self.removed else near

    def has(self, queries: DataFrame, tol: int = 0, col: str = "s") -> DataFrame:
        """(query, found): whether a string within tol is in the index, for each distinct query; null for a null query."""
        asked = queries.select(F.col(col).alias("query")).distinct()
        if tol == 0:
            hit = self.all().select(F.col("s").alias("query"), F.lit(True).alias("hit"))
        else:
            hit = self.search(asked, tol, "query").select("query", F.lit(True).alias("hit")).distinct()
        return asked.join(hit, "query", "left").select("query", F.when(F.col("query").isNotNull(), F.coalesce("hit", F.lit(False))).alias("found"))

    # -- changes

    def insert(self, strings: DataFrame, col: str = "s", order: list[str] | None = None) -> MetricIndex:
        """The version with these strings, numbered in the order of the columns `order` (the string itself if None)."""
        place = F.struct(*(order or [col]))
        new = strings.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("s")).agg(F.min(place).alias("place"))
        tombstones, removed = self.tombstones, self.removed
        if removed:
            tombstones = cut(self.tombstones.join(new, "s", "left_anti"))
            removed = tombstones.count()
        back = self.removed - removed
        new = cut(new.join(self.items, "s", "left_anti"))
        n = new.count()
        if not n:
            return replace(self, tombstones=tombstones, removed=removed, size=self.size + back)
        numbered = ordered.running(new, [], [F.col("place"), F.col("s")], F.lit(1), "rank")
        numbered = cut(numbered.select("s", (F.col("rank") + self.last).cast("long").alias("at")))
        parents = self._parents(numbered)
        items = numbered if not self.segments else cut(self.items.unionByName(numbered))
        segments = [*self.segments, Segment(cut(self._item_keys(numbered, dict(parents))), n)]
        while len(segments) > 1 and 2 * segments[-1].strings >= segments[-2].strings:
            b, a = segments.pop(), segments.pop()
            segments.append(Segment(cut(a.keys.unionByName(b.keys)), a.strings + b.strings))
        return replace(self, items=items, tombstones=tombstones, removed=removed, segments=tuple(segments), parents=parents, size=self.size + back + n, last=self.last + n)

    def remove(self, strings: DataFrame, col: str = "s") -> MetricIndex:
        """The version without these strings."""
        gone = cut(strings.select(F.col(col).alias("s")).distinct().join(self.all().select("s"), "s", "left_semi"))
        n = gone.count()
        if not n:
            return self
        tombstones = cut(self.tombstones.unionByName(gone)) if self.removed else gone
        out = replace(self, tombstones=tombstones, removed=self.removed + n, size=self.size - n)
        return out._merged() if out.removed >= out.size // 2 else out

    def remove_all(self) -> MetricIndex:
        empty = self.items.where("false")
        return replace(self, items=empty, tombstones=empty.select("s"), segments=(), size=0, removed=0)

    def _merged(self) -> MetricIndex:
        """The same strings in one segment, without tombstones."""
        if not self.size:
            return self.remove_all()
        items = cut(self.all())
        keys = self._item_keys(items, dict(self.parents))  # made again: there are many times as many of them as strings
        return replace(self, items=items, tombstones=self.tombstones.where("false"), segments=(Segment(cut(keys), self.size),), removed=0)

    # -- keys

    def _parents(self, strings: DataFrame) -> tuple[tuple[int, str], ...]:
        """A string for each length; a length keeps the one it has, as keys depend on it."""
        if self.metric != "hamming":
            return ()
        known = dict(self.parents)
        new = strings.where(~F.length("s").isin(list(known))) if known else strings
        return tuple(sorted((consensus(new, []) | known).items()))

    def _item_keys(self, strings: DataFrame, parents: dict[int, str]) -> DataFrame:
        """(s, far, kind, key)."""
        n, both = F.length("s"), []
        if self.metric == "hamming":
            if min(parents, default=0) <= MASKED:
                both.append(short_keys(strings.where(n <= MASKED), self.radius))
            if max(parents, default=0) > MASKED:
                return reduce(DataFrame.unionByName, [*map(_short, both), _keyed(strings.where(n > MASKED), Keys(self.radius, parents), False, KINDS, [])])
            return _short(both[0])
        most = reach(self.radius)
        keys = _short(edit_keys(strings.where(n <= most), self.radius, [0], False))
        if max(lengths_of(strings), default=0) <= most - self.radius:
            return keys
        places = similarity.edit_places(strings.where(n > most - self.radius), self.radius)
        return keys.unionByName(places.select("s", F.lit(0).alias("far"), F.lit(0).alias("kind"), F.xxhash64("n", "i", "block").alias("key")))

    def _near(self, asked: DataFrame, keys: DataFrame) -> list[DataFrame]:
        """Tables (query, match, dist) of what is within the radius, removed strings included."""
        n, short, r = F.length("s"), keys.where(F.col("kind") == SHORT).select("s", "key"), self.radius
        out = []
        if self.metric == "hamming":
            known = dict(self.parents)
            some = asked.where(n.isin(list(known)))  # no other length is near
            if min(known, default=0) <= MASKED:
                out.append(short_pairs(short_keys(some.where(n <= MASKED), r), short, r))
            if max(known, default=0) > MASKED:
                queries = _keyed(some.where(n > MASKED), Keys(r, known), True, KINDS, []).withColumnRenamed("s", "query")
                out.append(self._verified(self._meet(queries, keys.where(F.col("kind") != SHORT).withColumnRenamed("s", "match"))))
        else:
            most = reach(r)
            out.append(edit_near(asked.where(n <= most), self.all().where(n <= most).select("s"), r, self.metric, short))
            if max(lengths_of(asked), default=0) > most - r:
                places = keys.where(F.col("kind") != SHORT).select(F.col("s").alias("match"), "key")
                queries = asked.where(n > most - r).select(F.col("s").alias("query"), F.explode(similarity.blocks(F.col("s"), r)).alias("k")).select("query", F.xxhash64("k.n", "k.i", "k.block").alias("key"))
                far = queries.join(places.hint("merge"), "key").where(F.greatest(F.length("query"), F.length("match")) > most)
                out.append(self._verified(far))
        return [x.toDF("query", "match", "dist") for x in out]

    def _verified(self, found: DataFrame) -> DataFrame:
        dist = similarity.METRICS[self.metric](F.col("query"), F.col("match"))
        return found.select("query", "match").distinct().withColumn("dist", dist.cast("int")).where(F.col("dist") <= self.radius)

    def _meet(self, queries: DataFrame, items: DataFrame) -> DataFrame:
        # two strings with few changes meet by these; others by the kind of the far one
        queries = queries.withColumnRenamed("far", "query_far")
        near_q, near_i = F.col("query_far") == NEAR, F.col("far") == NEAR
        meetings = [
            (queries.where(near_q & (F.col("kind") == NEAR)), items.where(near_i & (F.col("kind") == NEAR))),
            (queries.where(~near_q & (F.col("kind") == F.col("query_far"))), items.where(F.col("kind") != NEAR)),
            (queries.where(near_q & (F.col("kind") != NEAR)), items.where(~near_i & (F.col("kind") == F.col("far")))),
        ]
        return reduce(DataFrame.unionByName, (q.join(i.hint("merge"), ["kind", "key"]).select("query", "match") for q, i in meetings))


def _short(keys: DataFrame) -> DataFrame:
    return keys.select("s", F.lit(0).alias("far"), F.lit(SHORT).alias("kind"), "key")
