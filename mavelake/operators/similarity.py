"""Similarity joins over strings: search, nearest distance, and greedy grouping.

A Hamming radius over strings of one length is an equi-join (see `neighbours`), and so is an edit distance between short strings
(see `edits`); between long ones it is one with d + 1 blocks that may have moved. Candidates are verified, so results are exact.

Greedy choices in an order (groups of similar sequences, UMIs that count once) run as rounds over the table of near pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import hamming, hamming_shift
from ..plans.scratch import cut
from .edits import LETTERS, count, edit_near, reach
from .meeting import distances, letters
from .neighbours import MASK_KEYS, hamming_pairs, longest

INT_MAX = 2147483647
METRICS = {"hamming": hamming, "hamming_shift": hamming_shift, "levenshtein": F.levenshtein}


def metric(name: str):
    if name not in METRICS:
        raise ValueError(f"unknown distance metric '{name}'; one of {', '.join(METRICS)}")
    return METRICS[name]


def blocks(s: Column, d: int) -> Column:
    """The d + 1 blocks of a string with their numbers and the string's length."""
    n = F.length(s)

    def one(i: Column) -> Column:
        a = F.floor(n * i / (d + 1)).cast("int")
        b = F.floor(n * (i + 1) / (d + 1)).cast("int")
        return F.struct(n.alias("n"), i.alias("i"), F.substring(s, a + 1, b - a).alias("block"))

    return F.transform(F.sequence(F.lit(0), F.lit(d)), one)


def edit_pairs(left: DataFrame, right: DataFrame, d: int) -> DataFrame:
    """Candidates (a, b) that hold all strings a of left and b of right within edit distance d.

    Of the d + 1 blocks of a, one is in b unchanged, at most d places away from where it is in a, and the lengths differ by at
    most d: so b is listed by what it has at all those places, for all those lengths."""
    one = left.select(F.col("s").alias("a"), F.explode(blocks(F.col("s"), d)).alias("k")).select("a", "k.*")
    two = edit_places(right, d).withColumnRenamed("s", "b")
    found = one.join(two.hint("merge"), ["n", "i", "block"]).select("a", "b").distinct()
    return found.where(F.size(F.array_except(grams("a"), grams("b"))) <= 2 * d)


def edit_places(strings: DataFrame, d: int) -> DataFrame:
    """(s, n, i, block): what each string has at all places where block i of a string of length n near it may be."""
    block = f"""transform(sequence(greatest(0, length(s) - {d}), length(s) + {d}), n -> transform(sequence(0, {d}), i -> transform(sequence(-{d}, {d}), o ->
        struct(n, i, cast(floor(n * i / {d + 1}) AS int) + o AS at, cast(floor(n * (i + 1) / {d + 1}) AS int) - cast(floor(n * i / {d + 1}) AS int) AS size))))"""
    places = strings.select("s", F.explode(F.expr(f"filter(flatten(flatten({block})), x -> x.at >= 0 AND x.at + x.size <= length(s))")).alias("x"))
    return places.selectExpr("s", "x.n", "x.i", "substring(s, x.at + 1, x.size) AS block").distinct()


def grams(s: str) -> Column:
    """The distinct pairs of adjacent letters of a string; an edit takes two of them away at most."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))


def similarity_search(strings: DataFrame, queries: DataFrame, tol: int, name: str = "hamming", col: str = "s") -> DataFrame:
    """(query, match, dist) for all distinct strings within tol of each query."""
    metric(name)
    s, q = (x.select(F.col(col).alias("s")).distinct() for x in (strings, queries))
    if name == "hamming":
        return hamming_pairs(q, s, tol).toDF("query", "match", "dist")
    return within(q, s, tol, name).toDF("query", "match", "dist")


def within(left: DataFrame, right: DataFrame, d: int, name: str) -> DataFrame:
    """(a, b, dist): the pairs of distinct strings a of left and b of right within an edit distance or a distance with shifts. A
    shift by k costs 2 k, as much as k insertions and k deletions: no distance is below the edit distance."""
    most, n = reach(d), F.length("s")
    out = edit_near(left.where(n <= most), right.where(n <= most), d, name)
    if longest(left, right) > most:
        far = edit_pairs(left.where(n > most - d), right.where(n > most - d), d).where(F.greatest(F.length("a"), F.length("b")) > most)
        out = out.union(far.withColumn("dist", METRICS[name](F.col("a"), F.col("b"))).where(F.col("dist") <= d))
    return out


#: Strings that are compared with all others rather than looked up: so many for each key that a string would have, and where keys
#: don't reach; the sizes of the blocks that are compared at once.
PER_KEY, FEW, BLOCK_LEFT, BLOCK_RIGHT = 44, 1 << 15, 512, 2048


def nearest_of_all(left: DataFrame, right: DataFrame, n_left: int, n_right: int, name: str) -> DataFrame:
    """(s, dist): the least distance of each string of a small table to those of right that aren't itself, by comparing all."""

    def packed(df: DataFrame, n: int, size: int, out: str) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("s"), F.lit(-(-n // size))).alias("block")).agg(F.collect_list("s").alias(out)).select(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                a, b = (batch.column(i)[at].values for i in (0, 1))
                (x, n), (y, m) = letters(a), letters(b)
                least = np.full(len(x), INT_MAX, np.int64)
                for one in np.unique(n):
                    for two in np.unique(m):
                        rows = np.flatnonzero(n == one)
                        dist = distances(name, x[rows, None, :one], y[None, m == two, :two], int(one), int(two))
                        if dist is not None:
                            dist = np.where(dist == 0, INT_MAX, dist.astype(np.int32)).min(1)  # only a string itself is at no distance
                            least[rows] = np.minimum(least[rows], dist)
                got = np.flatnonzero(least < INT_MAX)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(got)), pa.array(least[got].astype(np.int32))], ["s", "dist"])

    blocks = packed(right, n_right, BLOCK_RIGHT, "t").repartition(min(-(-n_right // BLOCK_RIGHT), int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pairs = blocks.crossJoin(F.broadcast(packed(left, n_left, BLOCK_LEFT, "s"))).select("s", "t")
    return pairs.mapInArrow(run, "s string, dist int").groupBy("s").agg(F.min("dist").alias("dist"))


def nearest_string_dist(strings: DataFrame, name: str = "hamming", id_col: str = "id", col: str = "s") -> DataFrame:
    """(id, dist): the least distance of each string to any other element; INT_MAX where there is no other.

    The radius grows, and only strings without a neighbour so far go on. As soon as they are so few that comparing them with all
    strings is less work than the keys of all strings for the next radius, they are compared.
    """
    metric(name)
    base = strings.select(F.col(id_col).alias("id"), F.col(col).alias("s"))
    counts = base.groupBy("s").agg(F.count("*").alias("n"))
    all_ = cut(counts.select("s"))
    lengths = all_.agg(F.max(F.length("s")).alias("m"), F.countDistinct(F.length("s")).alias("k")).collect()[0]
    if lengths.k and lengths.k > 1 and name == "hamming":
        raise ValueError("the Hamming distance needs strings of one length")
    most = lengths.m or 0  # no distance is above that
    parts = [counts.where("n > 1").select("s", F.lit(0).alias("dist"))]
    open_ = cut(counts.where("n = 1").select("s"))
    n_all = all_.count()
    d = 1
    while n_open := open_.count():
        radius = min(d, most)
        keys = MASK_KEYS if name == "hamming" else count(most, radius) if most <= reach(radius) else 0
        if most <= LETTERS and n_open <= (PER_KEY * keys or FEW):
            parts.append(cut(nearest_of_all(open_, all_, n_open, n_all, name)))
            break
        near = hamming_pairs(open_, all_, radius) if name == "hamming" else within(open_, all_, radius, name)
        near = cut(near.where("a <> b").groupBy("a").agg(F.min("dist").alias("dist")).toDF("s", "dist"))
        parts.append(near)
        if d >= most:
            break
        open_ = cut(open_.join(near, "s", "left_anti"))
        d += max(1, d // 2)
    found = reduce(DataFrame.union, parts)
    return base.join(found, "s", "left").select("id", F.coalesce("dist", F.lit(INT_MAX)).cast("int").alias("dist"))


#: Open edges that one task settles at the end: a fixed number of pairs of ids, whatever the input.
TAIL = 1 << 18


def settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, rep): the outcome of going through all nodes s in an order, where a node that isn't taken yet takes all later ones
    that an edge (q, prio, s) from it leads to; prio is q's place in the order. Nodes that aren't taken have themselves as rep.

    In rounds: a node that no open edge leads to isn't taken, and all that it leads to are; both then leave with their edges, so
    only what is still open goes into the next round. The last TAIL edges are gone through in order. A taken node's rep is the
    first of those that lead to it and stay."""
    open_nodes, open_edges = nodes.select("s"), edges
    rounds = []
    while open_edges.count() > TAIL:
        free = cut(open_nodes.join(open_edges.select("s"), "s", "left_anti"))
        rounds.append(free)
        gone = cut(free.union(open_edges.join(free.toDF("q"), "q").select("s").distinct()))
        open_nodes = cut(open_nodes.join(gone, "s", "left_anti"))
        open_edges = cut(open_edges.join(gone, "s", "left_anti").join(gone.toDF("q"), "q", "left_anti"))

    def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set = set()
        for frame in frames:
            new = []
            for q, s in zip(frame["q"], frame["s"], strict=True):
                if q not in taken and s not in taken:  # all that lead to q come before it
                    taken.add(s)
                    new.append(s)
            yield pd.DataFrame({"s": new})

    kind = nodes.schema["s"].dataType.simpleString()
    taken = cut(open_edges.repartition(1).sortWithinPartitions("prio").select("q", "s").mapInPandas(in_order, f"s {kind}"))
    rounds.append(open_nodes.join(taken, "s", "left_anti"))
    stay = cut(reduce(DataFrame.union, rounds).toDF("q"))
    first = edges.join(stay, "q").groupBy("s").agg(F.min(F.struct("prio", "q")).alias("f"))
    return nodes.select("s").join(first, "s", "left").select("s", F.coalesce("f.q", "s").alias("rep"))


#: Comparisons that one task makes for a group, and strings and kept ones that it compares at once.
COMPARED, TOGETHER, TILE = 1 << 33, 1024, 64


class _Kept:
    """The strings of one length that are kept so far, packed into words of 64 bits."""

    def __init__(self, n: int, tolerance: int, codes: dict[int, int]):
        self.n, self.tolerance, self.codes = n, tolerance, codes
        self.rows: list[np.ndarray] = []  # letters
        self.words = np.zeros((0, 0), np.uint64)
        self.bits = self.size = self.compared = 0

    def _pack(self, x: np.ndarray) -> np.ndarray:
        """16 letters a word as long as a task meets no more than 16 of them, otherwise two."""
        if self.bits == 4:
            x = np.array([self.codes.get(c, 0) for c in range(256)], np.uint64)[x]
        per = 64 // self.bits
        x = np.pad(x.astype(np.uint64), ((0, 0), (0, -x.shape[1] % per))).reshape(len(x), -1, per)
        return (x << (np.arange(per, dtype=np.uint64) * np.uint64(self.bits))).sum(2, dtype=np.uint64)

    def _near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.compared += len(a) * len(b)
        far = np.zeros((len(a), len(b)), np.uint16)
        ones = np.uint64(sum(1 << i for i in range(0, 64, self.bits)))
        for word in range(a.shape[1]):
            z = a[:, word, None] ^ b[None, :, word]
            shift = self.bits // 2
            while shift:
                z |= z >> np.uint64(shift)
                shift //= 2
            z &= ones
            far = np.bitwise_count(z) if a.shape[1] == 1 else far + np.bitwise_count(z)
        return far <= self.tolerance

    def keep(self, x: np.ndarray) -> np.ndarray:
        """Which of the next strings in order, by rows of letters, are kept."""
        if self.bits != 32:
            for c in np.unique(x).tolist():
                self.codes.setdefault(c, len(self.codes))
            bits = 4 if len(self.codes) <= 16 and max(self.codes) < 256 else 32
            if bits != self.bits:
                self.bits = bits
                self.words = self._pack(np.concatenate(self.rows).astype(np.int64)) if self.rows else np.zeros((0, -(-self.n // (64 // bits))), np.uint64)
        words = self._pack(x)
        left = np.arange(len(x))
        for end in range(self.size, 0, -TILE):  # the latest are the likeliest to be near
            left = left[~self._near(words[left], self.words[max(0, end - TILE) : end]).any(1)]
            if not len(left):
                return left
        open_, new = np.ones(len(left), bool), []
        for at in range(len(left)):
            if open_[at]:
                new.append(left[at])
                open_[at:] &= ~self._near(words[left[at :]], words[left[at : at + 1]])[:, 0]
        new = np.array(new)
        while self.size + len(new) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros((max(TILE, len(self.words)), words.shape[1]), np.uint64)])
        self.words[self.size : self.size + len(new)] = words[new]
        self.size += len(new)
        self.rows.append(x[new])
        return new


def _kept_in_order(rows: DataFrame, tolerance: int, by: list[str]) -> DataFrame:
    """(by, umi, kept): the kept UMIs of each group, in one pass over its UMIs in their order; where a group takes a task more than
    COMPARED comparisons, also those that it hasn't looked at, with kept as false."""
    dealt = rows.select(*by, F.length("umi").alias("n"), "umi").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, int] = {}
        last, kept = None, None
        for batch in batches:
            new = np.zeros(len(batch), bool)
            for c in range(len(by) + 1):
                column = batch.column(c)
                new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new).tolist(), len(batch)] if len(batch) else [0]
            for start, end in zip(starts, starts[1:], strict=False):
                group = tuple(batch.column(c)[start].as_py() for c in range(len(by) + 1))
                if group != last or None in group:
                    last, kept = group, _Kept(group[-1], tolerance, codes)
                for at in range(start, end, TOGETHER):
                    part = batch.slice(at, min(TOGETHER, end - at))
                    looked = kept.compared <= COMPARED
                    if looked:
                        x, _ = letters(part.column(len(by) + 1))
                        part = part.take(pa.array(kept.keep(x[:, : kept.n]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(by))), part.column(len(by) + 1), pa.array(np.full(len(part), looked))], [*by, "umi", "kept"])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by) + "umi string, kept boolean"
    return dealt.sortWithinPartitions(*by, "n", "umi").mapInArrow(run, schema)


def collapse_umis(umis: DataFrame, tolerance: int, by: list[str]) -> DataFrame:
    """(by, umi): the distinct UMIs of each group that are kept when, in their order, one is kept unless one of its group that
    is kept already is within the tolerance.

    A task goes through a group's sorted UMIs and holds the kept ones only, which are few where UMIs crowd their space, while near
    pairs there grow with the square of the group. A group of many kept ones has few near pairs: what a task leaves of it becomes
    an edge table of near pairs, settled in rounds."""
    rows = umis.select(*by, "umi").distinct()
    if tolerance <= 0:
        return rows
    # those no longer than the tolerance are all within it: the first of each length is kept
    short = rows.where(F.length("umi") <= tolerance).groupBy(*by, F.length("umi").alias("n")).agg(F.min("umi").alias("umi")).select(*by, "umi")
    seen = cut(_kept_in_order(rows.where(F.length("umi") > tolerance), tolerance, by))
    kept, rest = (seen.where(x).select(*by, "umi") for x in ("kept", "NOT kept"))
    if not rest.isEmpty():
        taken = hamming_pairs(rest.withColumnRenamed("umi", "s"), kept.withColumnRenamed("umi", "s"), tolerance, by=by).select(*by, F.col("a").alias("umi")).distinct()
        kept = kept.union(_kept_by_edges(rest.join(taken, [*by, "umi"], "left_anti"), tolerance, by))
    return kept.union(short)


def _kept_by_edges(rows: DataFrame, tolerance: int, by: list[str]) -> DataFrame:
    long = cut(rows.select(*by, "umi", F.monotonically_increasing_id().alias("id")))
    near = hamming_pairs(long.withColumnRenamed("umi", "s"), long.withColumnRenamed("umi", "s"), tolerance, by=by).where("a < b")
    ids = [long.select(*by, F.col("umi").alias(x), F.col("id").alias(y)) for x, y in (("a", "q"), ("b", "s"))]
    edges = cut(near.join(ids[0], [*by, "a"]).join(ids[1], [*by, "b"]).select("q", F.col("a").alias("prio"), "s"))
    kept = settle(long.select(F.col("id").alias("s")), edges).where("s = rep")
    return long.join(kept.select(F.col("s").alias("id")), "id", "left_semi").select(*by, "umi")


def group_similar_sequences(sequences: DataFrame, max_dist: float = 0, min_score: float = 0, min_ratio: float = 0, seq_col: str = "sequence", score_col: str = "score", parent: str | None = None) -> DataFrame:
    """(sequence, representative): greedy groups around sequences of high score.

    In order of score (descending) and sequence, a sequence that isn't taken yet takes all that are left within the distance
    and whose score times min_ratio isn't above its own; below min_score, all stand alone. The first of repeated sequences
    (highest score) counts. `parent` is the sequence that the others were made from, if known.
    """
    s = sequences.select(F.col(seq_col).alias("s"), F.col(score_col).cast("double").alias("score")).groupBy("s").agg(F.max("score").alias("score"))
    lengths = s.select(F.length("s").alias("n")).distinct().limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("all sequences must have the same length")
    n = (lengths[0].n if lengths else 0) - (1 if s.where(F.contains("s", F.lit("_"))).limit(1).count() else 0)
    tol = int(max_dist if max_dist >= 1 else max_dist * n)
    nodes = cut(s)
    if lengths and tol >= lengths[0].n:
        # all are within the distance of all: the first takes whatever its score allows, which is at least what any other may take
        top = nodes.orderBy(F.desc("score"), "s").limit(1).toDF("top", "top_score")
        taken = (F.col("top_score") >= min_score) & (F.col("top_score") >= min_ratio * F.col("score"))
        return nodes.crossJoin(F.broadcast(top)).select(F.col("s").alias("sequence"), F.when(taken, F.col("top")).otherwise(F.col("s")).alias("representative"))
    near = hamming_pairs(nodes.select("s"), nodes.select("s"), tol, parent).where("a <> b").select("a", "b")
    q, t = nodes.toDF("a", "qs"), nodes.toDF("b", "ts")
    before = (F.col("qs") > F.col("ts")) | ((F.col("qs") == F.col("ts")) & (F.col("a") < F.col("b")))
    allowed = F.col("qs") >= min_ratio * F.col("ts")
    if min_score > 0:
        allowed = allowed & (F.col("qs") >= min_score)
    prio = F.struct((-F.col("qs")).alias("p"), F.col("a").alias("s"))
    edges = cut(near.join(q, "a").join(t, "b").where(before & allowed).select(F.col("a").alias("q"), prio.alias("prio"), F.col("b").alias("s")))
    return settle(nodes.select("s"), edges).toDF("sequence", "representative")
