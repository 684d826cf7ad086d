"""Pairs of strings within a Hamming distance, as equi-joins on keys that two such strings must share.

Three kinds of keys, each exact by itself:

* Masks, for short strings: what is left of a string without d of its parts (places, if these give no more than MASK_KEYS
  keys). A key's strings differ in these parts only, so its bucket is bounded by the alphabet, whatever the strings are.
* Changes against a parent, for libraries made from one sequence, whose strings share nearly all of it. Two strings with j and
  i changes of their own (R being those they share) are within d if j + i - (places that both change) is at most d. So a
  string's keys are, for each choice of up to d of its changes, what remains of them, with as many of the chosen places as
  must be shared. Strings meet at a key only if they are within d: the parent's own letters are in no key.
* Blocks, for strings far from the parent (too many choices): of d + 1 blocks two strings within d share one. A far string
  that has a block of the parent's could meet the whole library there; it is keyed by changed parts instead, of which its
  partners share all but d, so the first d + 1 of each string in a fixed order are enough.

Pairs are verified and named once. `parent` is the commonest letter of each place where it isn't given.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import hamming
from .meeting import Bucket, chosen, differing, first_of, keyed, meet, mix, numbered

#: Choices of changes and masks that a string may have as keys; strings longer than MASKED aren't masked.
KEYS, MASK_KEYS, MASKED = 600, 40, 24
NEAR, PARTS, PLACES, BLOCKS = range(4)


def _letters(strings: list[str], n: int) -> np.ndarray:
    """A row per string of its code points."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), n).astype(np.uint64)


def choices(k: int, d: int) -> int:
    """Keys of a string with k changes."""
    return sum(comb(k, j) * sum(comb(j, max(0, j + i - d)) for i in range(d + 1)) for j in range(min(k, d) + 1))


def mask_parts(n: int, d: int) -> int:
    return max(b for b in range(d, n + 1) if b == d + 1 or comb(b, d) <= MASK_KEYS)


def mask_keys(x: np.ndarray, d: int) -> Iterator[np.ndarray]:
    n = x.shape[1]
    parts = mask_parts(n, d)
    letter = mix(x + (np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
    part = np.add.reduceat(letter, np.array(_cuts(n, parts)[:-1]), axis=1)
    whole = part.sum(1, dtype=np.uint64)
    for number, mask in enumerate(combinations(range(parts), d)):
        yield mix(whole - part[:, list(mask)].sum(1, dtype=np.uint64) + mix(np.uint64(number + 7)))


def change_keys(x: np.ndarray, parent: np.ndarray, d: int, left: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) for strings with few changes, all of the same number of changes."""
    k = (x != parent).sum(1)
    for changes in np.unique(k):
        rows = np.flatnonzero(k == changes)
        place = np.nonzero(x[rows] != parent)[1].reshape(len(rows), changes).astype(np.uint64)
        letter = np.take_along_axis(x[rows], place.astype(np.int64), 1)
        change, where = mix(letter + (place << np.uint64(32)) + np.uint64(1)), mix(place + np.uint64(1 << 62))
        whole = change.sum(1, dtype=np.uint64)
        for j in range(min(d, changes) + 1):
            for own in combinations(range(changes), j):
                rest = mix(whole - change[:, list(own)].sum(1, dtype=np.uint64))
                for i in range(d + 1):  # as many changes of the other's own
                    label = mix(np.uint64((j << 16 | i) if left else (i << 16 | j)))
                    for shared in combinations(own, max(0, j + i - d)):
                        yield rows, mix(rest + label + where[:, list(shared)].sum(1, dtype=np.uint64))


def _cuts(n: int, parts: int) -> list[int]:
    return [n * i // parts for i in range(parts + 1)]


def part_keys(x: np.ndarray, parent: np.ndarray, cuts: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): of each string the changed parts, at most so many, in the order of their keys."""
    n = x.shape[1]
    letter = mix(x + (np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
    at = np.array(cuts[:-1])
    keys = mix(np.add.reduceat(letter, at, axis=1)) >> np.uint64(1)
    changed = np.add.reduceat((x != parent).astype(np.int64), at, axis=1) > 0
    keys = np.sort(np.where(changed, keys, np.uint64(1 << 63)), axis=1)[:, :most]
    rows, columns = np.nonzero(keys < np.uint64(1 << 63))
    return rows, keys[rows, columns]


class Keys:
    """The keys of strings, for one distance and the parent of each length."""

    def __init__(self, d: int, parents: dict[int, str]):
        self.d, self.parents = d, parents
        self.most = max((k for k in range(64) if choices(k, d) <= KEYS), default=-1)  # choices grow with k

    def kind(self, x: np.ndarray, parent: np.ndarray) -> np.ndarray:
        n, d = x.shape[1], self.d
        changed = x != parent
        k = changed.sum(1)
        parts = np.add.reduceat(changed, np.array(_cuts(n, min(n, 2 * d + 2))[:-1]), axis=1).astype(bool).sum(1)
        blocks = np.add.reduceat(changed, np.array(_cuts(n, min(n, d + 1))[:-1]), axis=1).astype(bool)
        far = np.where(blocks.all(1), BLOCKS, np.where(parts > d, PARTS, np.where(k > d, PLACES, BLOCKS)))
        return np.where(k <= self.most, NEAR, far)

    def of(self, strings: list[str], left: bool, kinds: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(rows, own kinds of these, keys, kind of the keys) of strings of any lengths."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        for n in np.unique(lengths):
            at, d = np.flatnonzero(lengths == n), self.d
            salt = mix(np.uint64(n))
            if n <= d:
                yield at, np.full(len(at), NEAR), np.full(len(at), salt), NEAR
                continue
            x = _letters([strings[i] for i in at], int(n))
            if n <= MASKED:
                for keys in mask_keys(x, d):
                    yield at, np.full(len(at), NEAR), keys ^ salt, NEAR
                continue
            parent = _letters([self.parents[int(n)]], int(n))[0]
            own = self.kind(x, parent)
            near = np.flatnonzero(own == NEAR)
            if len(near):
                for rows, keys in change_keys(x[near], parent, d, left):
                    yield at[near[rows]], own[near[rows]], keys ^ salt, NEAR
            if PARTS in kinds:
                rows, keys = part_keys(x, parent, _cuts(int(n), min(int(n), 2 * d + 2)), d + 1)
                yield at[rows], own[rows], keys ^ salt, PARTS
            if PLACES in kinds:
                rows, keys = part_keys(x, parent, list(range(int(n) + 1)), d + 1)
                yield at[rows], own[rows], keys ^ salt, PLACES
            if BLOCKS in kinds:
                letter = mix(x + (np.arange(n, dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
                for keys in mix(np.add.reduceat(letter, np.array(_cuts(int(n), d + 1)[:-1]), axis=1)).T:
                    yield at, own, keys ^ salt, BLOCKS


def consensus(strings: DataFrame, by: list[str]) -> dict[int, str]:
    """The commonest letter of each place, for each length: one string per length."""
    letters = strings.select("s", *by).select(F.length("s").alias("n"), F.posexplode(F.split("s", ""))).groupBy("n", "pos", "col").agg(F.count("*").alias("m"))
    best = letters.groupBy("n", "pos").agg(F.max(F.struct("m", "col")).alias("x"))
    rows = best.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x.col"))), lambda x: x["col"]), "").alias("s")).collect()
    return {r.n: r.s for r in rows}


def _keyed(df: DataFrame, keys: Keys, left: bool, kinds: set[int], by: list[str]) -> DataFrame:
    """(by, s, far, kind, key) for a column s."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), 2048):
                frame = whole.iloc[start : start + 2048]
                found = [(r, f, np.full(len(r), kind), k.astype(np.int64)) for r, f, k, kind in keys.of(frame["s"].tolist(), left, kinds)]
                if found:
                    rows, far, kind, key = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield frame.iloc[rows].assign(far=far.astype(np.int32), kind=kind.astype(np.int32), key=key)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, "s"]) + ", far int, kind int, key long"
    return df.select(*by, "s").mapInPandas(run, schema)


def candidates(left: DataFrame, right: DataFrame, d: int, parent: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, a, b), repeats included: all pairs of strings within distance d, and others that share a key."""
    by = by or []
    most = longest(left, right)
    parents: dict[int, str] = {}
    kinds: set[int] = set()
    if most > max(d, MASKED):
        both = left.select(*by, "s") if left is right else left.select(*by, "s").union(right.select(*by, "s"))
        parents = consensus(both, by) if parent is None else {len(parent): parent}
        if parent is not None:
            parents = consensus(both.where(F.length("s") != len(parent)), by) | parents
        keys = Keys(d, parents)

        def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: set[int] = set()
            for frame in frames:
                strings = frame["s"].tolist()
                for n in {len(s) for s in strings if len(s) > max(d, MASKED)}:
                    some = [s for s in strings if len(s) == n]
                    found |= set(keys.kind(_letters(some, n), _letters([parents[n]], n)[0]).tolist())
            yield pd.DataFrame({"kind": sorted(found)})

        kinds = {r.kind for r in both.select("s").mapInPandas(seen, "kind int").distinct().collect()}  # 4 at most
    keys = Keys(d, parents)
    x = _keyed(left, keys, True, kinds, by).withColumnRenamed("s", "a")
    y = _keyed(right, keys, False, kinds, by).withColumnRenamed("s", "b")
    on = [*by, "kind", "key"]
    # a pair meets by the keys of a far string's own kind, or, if both are near, by their changes
    # a table of keys is many times the table that Spark estimates it by, so it must not be broadcast
    parts = [x.where("far = 0 AND kind = 0").join(y.where("far = 0 AND kind = 0").drop("far").hint("merge"), on)]
    if kinds - {NEAR}:
        parts += [x.where("far > 0 AND kind = far").join(y.where("kind > 0").drop("far").hint("merge"), on), x.where("kind > 0").drop("far").join(y.where("far > 0 AND kind = far").hint("merge"), on)]
    out = parts[0].select(*by, "a", "b")
    for p in parts[1:]:
        out = out.union(p.select(*by, "a", "b"))
    return out


def short_keys(df: DataFrame, d: int, by: list[str] | None = None) -> DataFrame:
    """(by, s, key) for strings of at most MASKED letters, by masks; the key ends with the mask's number."""

    def keys(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, n = np.arange(len(x)), x.shape[1]
        salt = mix(np.uint64(n))
        if n <= d:
            yield at, numbered(np.full(len(x), salt), 0)
            return
        for number, key in enumerate(mask_keys(x, d)):
            yield at, numbered(key ^ salt, number)

    return keyed(df, keys, by)


def short_pairs(left: DataFrame, right: DataFrame, d: int, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, dist): the pairs within distance d of two tables of short_keys, each once: by the first mask that they share."""

    def near(rows: Bucket, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = differing(rows.x[a], rows.x[b])
        dist = np.bitwise_count(places).astype(np.int64)
        take = np.flatnonzero((dist <= d) & (rows.n[a] == rows.n[b]))
        places, length, number = places[take], rows.n[a[take]], rows.number[a[take]]
        first = length <= d
        for n in np.unique(length[~first]):
            some = np.flatnonzero(length == n)
            parts = mask_parts(int(n), d)
            cuts = _cuts(int(n), parts)
            inside = np.zeros(len(some), np.uint64)
            for k in range(parts):
                part = np.uint64((1 << cuts[k + 1]) - (1 << cuts[k]))
                inside |= ((places[some] & part) != 0).astype(np.uint64) << np.uint64(k)
            masks = chosen(parts, d)
            first[some] = first_of(masks[np.minimum(number[some], len(masks) - 1)], inside)
        take = take[first]
        return take, dist[take]

    return meet(left, right, near, by)


def longest(*tables: DataFrame) -> int:
    return max((r.n or 0 for x in tables for r in x.agg(F.max(F.length("s")).alias("n")).collect()), default=0)


def hamming_pairs(left: DataFrame, right: DataFrame, d: int, parent: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, dist) for strings a of left (column s) and b of right within Hamming distance d, equal ones included; with
    `by`, only strings that agree in these columns are compared. Both have distinct rows."""
    if longest(*([left] if left is right else [left, right])) <= MASKED:
        return short_pairs(short_keys(left, d, by), short_keys(right, d, by), d, by)
    found = candidates(left, right, d, parent, by).distinct()
    return found.withColumn("dist", hamming(F.col("a"), F.col("b"))).where(F.col("dist") <= d)
