"""Pairs of strings that share a key, without a row for each candidate: rows are dealt out and sorted by their key, and a task
goes through the buckets with arrays. What doesn't hold is dropped there, and so are pairs that another key names too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are looked at together, and pairs that are compared at once.
ROWS, PAIRS = 1 << 16, 1 << 18
#: A key's last bits are the number of what it leaves out.
NUMBERS = 1 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: equal inputs give equal keys, and different ones hardly ever."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):  # of single numbers; arrays wrap anyway
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def numbered(keys: np.ndarray, number: int) -> np.ndarray:
    return keys & ~np.uint64(NUMBERS - 1) | np.uint64(number)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row per string of its code points, zeros after its end, and the lengths."""
    n = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(8, -(-int(n.max(initial=0)) // 8) * 8)
    if len(column) and pc.all(pc.string_is_ascii(column)).as_py():
        flat = pc.ascii_rpad(column, width, "\0").buffers()[2]
        return np.frombuffer(flat, np.uint8, len(n) * width).reshape(len(n), width), n
    text = "".join(s.ljust(width, "\0") for s in column.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(n), width), n


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A bit for each place at which two strings of at most 64 letters differ."""
    out = np.zeros(len(x), np.uint64)
    if x.dtype != np.uint8 or y.dtype != np.uint8:
        for p in range(min(x.shape[1], 64)):
            out |= (x[:, p] != y[:, p]).astype(np.uint64) << np.uint64(p)
        return out
    x, y = x.view(np.uint64), y.view(np.uint64)
    for word in range(x.shape[1]):
        z = x[:, word] ^ y[:, word]
        for shift in (4, 2, 1):
            z |= z >> np.uint64(shift)
        z &= np.uint64(0x0101010101010101)
        out |= ((z * np.uint64(0x0102040810204080)) >> np.uint64(56)) << np.uint64(8 * word)
    return out


def first_of(mask: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether a mask is, of all with as many bits that hold `inside`, the one that fills up with the lowest bits."""
    return (inside & ~mask == 0) & (mask & ~inside < (~mask & (mask + np.uint64(1))))


def chosen(n: int, k: int) -> np.ndarray:
    """The masks of all choices of k of n, in the order of itertools.combinations."""
    from itertools import combinations

    return np.array([sum(1 << i for i in c) for c in combinations(range(n), k)], np.uint64)


def levenshtein(x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray:
    """Edit distances of strings of n and m letters, whose letters are the last axis; the other axes are broadcast."""
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    x, y = np.moveaxis(x, -1, 0).copy(), np.moveaxis(y, -1, 0).copy()
    kind = np.uint8 if n + m < 255 else np.int32
    row = [np.full(shape, j, kind) for j in range(m + 1)]
    one = kind(1)
    for i in range(n):
        before, row[0] = row[0], row[0] + one
        for j in range(m):
            best = np.minimum(row[j + 1], row[j]) + one
            best = np.minimum(best, before + (x[i] != y[j]))
            before, row[j + 1] = row[j + 1], best.astype(kind, copy=False)
    return row[m]


def hamming_shift(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of 2 |s| plus the differing places of the overlap, for strings of n letters; broadcast as above."""
    shape = np.broadcast_shapes(x.shape[:-1], y.shape[:-1])
    x, y = np.moveaxis(x, -1, 0).copy(), np.moveaxis(y, -1, 0).copy()
    best = np.full(shape, n, np.int32)
    for s in range(-(n - 1), n):
        if 2 * abs(s) >= n:
            continue
        far = np.full(shape, 2 * abs(s), np.uint8 if 3 * n < 255 else np.int32)
        for p in range(n - abs(s)):
            far += x[p + max(s, 0)] != y[p + max(-s, 0)]
        best = np.minimum(best, far)
    return best


def mismatches(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    far = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.int32)
    for p in range(n):
        far += x[..., p] != y[..., p]
    return far


def distances(name: str, x: np.ndarray, y: np.ndarray, n: int, m: int) -> np.ndarray | None:
    """None where the metric isn't defined for these lengths."""
    if name == "levenshtein":
        return levenshtein(x, y, n, m)
    return None if n != m else mismatches(x, y, n) if name == "hamming" else hamming_shift(x, y, n)


class Bucket:
    """Rows of whole buckets, in the order of their keys: letters, lengths and keys."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.column = table["s"].combine_chunks() if table["s"].num_chunks != 1 else table["s"].chunk(0)
        self.x, self.n = letters(self.column)
        self.key = table["key"].to_numpy().astype(np.uint64)
        self.number = (self.key & np.uint64(NUMBERS - 1)).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole buckets, with the first row of each."""
    held: list[pa.RecordBatch] = []
    rows, most = 0, ROWS

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[0] = True
        for c in [*by, "key"]:
            column = table[c].combine_chunks()
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if at[-1]:
                yield table.slice(0, at[-1]), at[:-1]
            held = table.slice(at[-1]).to_batches()
            rows = len(table) - at[-1]
            most = max(ROWS, 2 * rows)  # a bucket that doesn't end is not looked at again and again
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def meet(left: DataFrame, right: DataFrame, near: Callable[[Bucket, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], by: list[str] | None = None) -> DataFrame:
    """(by, a, b, dist): near() gets rows a of left and b of right (both with columns by, s and key) that share by and key, and says
    which of these pairs to take and at what distance."""
    by = by or []
    both = left.select(*by, "key", F.lit(False).alias("side"), "s").union(right.select(*by, "key", F.lit(True).alias("side"), "s"))
    for c in by:
        both = both.where(F.col(c).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in _buckets(batches, by):
            side = table["side"].to_numpy()
            size = np.diff(np.append(start, len(table)))
            lefts = np.add.reduceat((~side).astype(np.int64), start)
            bucket = np.repeat(np.arange(len(start)), size)
            a = np.flatnonzero(~side & (lefts < size)[bucket])  # those that meet any
            if not len(a):
                continue
            rows = Bucket(table)
            one, n = (start + lefts)[bucket[a]], (size - lefts)[bucket[a]]
            ends = np.cumsum(n)
            at = 0
            while at < len(a):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
                m = n[at:to]
                ia = np.repeat(a[at:to], m)
                ib = np.arange(int(m.sum())) + np.repeat(one[at:to] - (ends[at:to] - m - done), m)
                take, dist = near(rows, ia, ib)
                if len(take):
                    ia, ib = pa.array(ia[take]), pa.array(ib[take])
                    yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks().take(ia) for c in by), rows.column.take(ia), rows.column.take(ib), pa.array(dist.astype(np.int32))], [*by, "a", "b", "dist"])
                at = to

    schema = "".join(f"`{c}` {both.schema[c].dataType.simpleString()}, " for c in by) + "a string, b string, dist int"
    return both.repartition(*by, "key").sortWithinPartitions(*by, "key", "side").mapInArrow(run, schema)


def keyed(df: DataFrame, keys: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], by: list[str] | None = None) -> DataFrame:
    """(by, s, key) for a column s: keys() yields rows and their keys for the letters of strings of one length."""
    by = by or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x, n = letters(batch.column(len(by)))
                for length in np.unique(n):
                    some = np.flatnonzero(n == length)
                    found = list(keys(x[some, :length].astype(np.uint64)))
                    if found:
                        rows, key = (np.concatenate(c) for c in zip(*found, strict=True))
                        at_rows = pa.array(some[rows])
                        yield pa.RecordBatch.from_arrays([*(c.take(at_rows) for c in batch.columns), pa.array(key.astype(np.int64))], [*by, "s", "key"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by) + "s string, key long"
    return df.where(F.col("s").isNotNull()).select(*by, "s").mapInArrow(run, schema)
