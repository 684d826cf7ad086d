"""Pairs of strings within an edit distance, by keys that only such pairs share.

If d edits lead from a string of n letters to one of m, then i deletions from the first and j = i - (n - m) from the second leave
two strings that differ in d - i - j places at most. So for each difference n - m of lengths, a string's keys are what is left of
it without so many letters, with so many others masked. All strings of a bucket are within d of each other, however crowded the
space of strings is, where blocks of a few letters would be shared by nearly all.

The keys grow with a power of the length, so strings longer than `reach` are looked up by blocks (see `similarity`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meeting import NUMBERS, Bucket, chosen, differing, distances, first_of, keyed, meet, mix, numbered

#: Keys that a string may have for strings of its own length; larger tables of deletions aren't compared pair by pair.
KEYS, COMPARED = 600, 256
LETTERS = 62
#: The number of keys with deletions; those of masks alone are numbered by their mask.
DELETED = NUMBERS - 1


def shares(d: int, delta: int) -> list[tuple[int, int, int]]:
    """(i, j, k): deletions from either string and masked places, for strings whose lengths differ by delta."""
    return [(j + delta, j, k) for j in range(max(0, -delta), d + 1) if (k := d - 2 * j - delta) >= 0]


def count(n: int, d: int, delta: int = 0, left: bool = True, deleted: bool = False) -> int:
    """Keys of a string of n letters; deleted: only those with deletions from either side."""
    own = [((i if left else j), k) for i, j, k in shares(d, delta) if not deleted or i or j]
    return sum(comb(n, i) * comb(n - i, min(k, n - i)) for i, k in own if i <= n)


def reach(d: int) -> int:
    """The longest strings that are looked up by these keys."""
    return max((n for n in range(LETTERS + 1) if count(n, d) <= KEYS), default=-1)


def _class_keys(x: np.ndarray, i: int, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, keys) of strings of one length without i letters and with k of the others masked."""
    rows, n = x.shape
    rest = n - i
    k = min(k, rest)
    salt = mix(np.uint64((rest << 16) + (k << 8) + 5))
    # a letter's share for each place that it may have, after t letters before it are gone
    share = [mix(x + (np.maximum(np.arange(n) - t, 0).astype(np.uint64) << np.uint64(32)) + np.uint64(1)) for t in range(i + 1)]
    masked = mix(np.arange(rest, dtype=np.uint64) + np.uint64(1 << 61))
    for gone in combinations(range(n), i):
        kept = [p for p in range(n) if p not in gone]
        here = np.stack([share[sum(g < p for g in gone)][:, p] for p in kept], axis=1) if kept else np.zeros((rows, 0), np.uint64)
        whole = here.sum(1, dtype=np.uint64) + salt
        for number, mask in enumerate(combinations(range(rest), k)):
            at = list(mask)
            yield number, mix(whole - here[:, at].sum(1, dtype=np.uint64) + masked[at].sum(dtype=np.uint64))


def _deleted(x: np.ndarray, d: int, delta: int, left: bool) -> np.ndarray:
    """A row per string of its distinct keys with deletions from either side, ascending; zeros for repeats."""
    found = [numbered(key ^ mix(np.uint64(delta + 64)), DELETED) for i, j, k in shares(d, delta) if (i or j) and (i if left else j) <= x.shape[1] for _, key in _class_keys(x, i if left else j, k)]
    if not found:
        return np.zeros((len(x), 0), np.uint64)
    out = np.sort(np.stack(found, axis=1), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = 0
    return out


def edit_keys(df: DataFrame, d: int, deltas: list[int], left: bool, lengths: dict[int, list[int]] | None = None) -> DataFrame:
    """(s, key) of strings no longer than reach(d), for these differences (length of left minus that of right); lengths: for each
    difference, the lengths of strings that need its keys, all if None."""
    most = reach(d)

    def keys(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = x.shape[1]
        at = np.arange(len(x))
        for delta in deltas:
            if n > most or lengths is not None and n not in lengths[delta]:
                continue
            if delta == 0:
                for number, key in _class_keys(x, 0, d):
                    yield at, numbered(key, number)
            found = _deleted(x, d, delta, left)
            rows, columns = np.nonzero(found)
            yield rows, found[rows, columns]

    return keyed(df, keys)


def lengths_of(df: DataFrame) -> list[int]:
    return [r.n for r in df.where(F.col("s").isNotNull()).select(F.length("s").alias("n")).distinct().collect()]


def edit_near(left: DataFrame, right: DataFrame, d: int, name: str, same: DataFrame | None = None) -> DataFrame:
    """(a, b, dist): the pairs of distinct strings a of left and b of right, none longer than reach(d), within distance d by a metric
    that is never below the edit distance. `same` has the keys of right for strings of the same length, if they are there."""
    most, out = reach(d), []
    n_left, n_right = ([n for n in lengths_of(x) if n <= most] for x in (left, right))
    deltas = sorted({a - b for a in n_left for b in n_right if abs(a - b) <= d and (name == "levenshtein" or a == b)})
    if not deltas:
        return left.where("false").select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit(0).alias("dist"))
    l_of = {x: [n for n in n_left if n - x in n_right] for x in deltas}
    r_of = {x: [n for n in n_right if n + x in n_left] for x in deltas}
    own = [x for x in deltas if x or same is None]
    items = ([edit_keys(right, d, own, False, r_of)] if own else []) + ([same] if same is not None and 0 in deltas else [])
    # keys with deletions are compared pair by pair if there are few, so that each pair is named once
    few = all(count(n, d, x, deleted=True) * count(n - x, d, x, False, True) <= COMPARED for x in deltas for n in l_of[x])

    def near(rows: Bucket, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken, far = [], []
        n, m = rows.n[a], rows.n[b]
        for one, two in np.unique(np.stack([n, m], axis=1), axis=0).tolist():
            some = np.flatnonzero((n == one) & (m == two))
            ia, ib = a[some], b[some]
            gone = rows.number[ia] == DELETED
            take = np.ones(len(some), bool)
            if one == two:
                places = differing(rows.x[ia], rows.x[ib])
                masks = chosen(one, min(d, one))
                take = np.where(gone, np.bitwise_count(places) > d, first_of(masks[np.minimum(rows.number[ia], len(masks) - 1)], places))
            if few and (check := np.flatnonzero(take & gone)).size:
                take[check] = _first_key(rows, ia[check], ib[check], one, two, d)
            some, ia, ib = some[take], ia[take], ib[take]
            dist = distances(name, rows.x[ia, :one], rows.x[ib, :two], one, two)
            if dist is not None:
                taken.append(some[dist <= d])
                far.append(dist[dist <= d].astype(np.int64))
        return (np.concatenate(taken), np.concatenate(far)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    out = meet(edit_keys(left, d, deltas, True, l_of), reduce(DataFrame.union, items), near)
    return out if few else out.distinct()


def _first_key(rows: Bucket, a: np.ndarray, b: np.ndarray, n: int, m: int, d: int) -> np.ndarray:
    """Whether the key that a pair shares is the least of those with deletions that it shares."""
    (one, at), (two, to) = (np.unique(x, return_inverse=True) for x in (a, b))
    left = _deleted(rows.x[one, :n].astype(np.uint64), d, n - m, True)[at]
    right = _deleted(rows.x[two, :m].astype(np.uint64), d, n - m, False)[to]
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for column in range(left.shape[1]):
        key = left[:, column]
        shared = (right == key[:, None]).any(1) & (key > 0)
        least = np.where(shared, np.minimum(least, key), least)
    return least == rows.key[a]
