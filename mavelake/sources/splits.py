"""Byte ranges of FASTQ files, so that many tasks read one file.

Plain files are cut anywhere, block gzip (members that state their own size in a `BC` field) at its members. A record can't be
found from the middle of a file by its looks, as a quality may begin with `@`, so a first job counts the line breaks of each
range. Sums of these counts tell which line each range begins in, and so the number of every record, exactly: line 4r begins
record r. A range owns the records whose first line comes after one of its own line breaks (the first range of a file owns
record 0 too), and its task reads on past its end to finish the last. The mate of record r is found in the same way, in the
last range of the other file that begins before it: mates stay in lock step without a join.

Three numbers for each range come to the driver and are broadcast (24 bytes for `split_bytes` of input). Other gzip files
can't be split: such a file, or a pair with one, is one range. The files are read twice, the first time for line breaks only.
"""

from __future__ import annotations

import io
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PLAIN, BLOCKS, WHOLE = 0, 1, 2
SPLIT_BYTES = 128 << 20
#: A member with extra fields, of which the first states the member's size less one. A member has at most 65,536 bytes.
MEMBER = re.compile(rb"\x1f\x8b\x08\x04.{4}.{2}\x06\x00BC\x02\x00(.{2})", re.S)
MEMBER_HEAD, MEMBER_MOST, CHAINED = 18, 1 << 16, 3


def raw(path: str):
    """A file for reading bytes from any place."""
    if "://" in path:
        from pyarrow import fs as pafs

        system, name = pafs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return open(path, "rb")


def size_of(path: str) -> int:
    if "://" in path:
        from pyarrow import fs as pafs

        system, name = pafs.FileSystem.from_uri(path)
        return system.get_file_info(name).size
    return os.path.getsize(path)


def kind_of(path: str) -> int:
    """How a file can be cut."""
    if not path.endswith(".gz"):
        return PLAIN
    with raw(path) as f:
        return BLOCKS if MEMBER.match(f.read(MEMBER_HEAD)) else WHOLE


def first_member(f, start: int, size: int) -> int:
    """Where the first member at or after start begins (the file's size if there is none). What looks like a member must be
    followed by others, or by the end."""
    if start == 0:
        return 0
    f.seek(start)
    window = f.read((CHAINED + 1) * MEMBER_MOST)
    for m in re.finditer(b"(?=" + MEMBER.pattern + b")", window, re.S):
        at = m.start()
        for _ in range(CHAINED):
            head = MEMBER.match(window, at)
            if head is None:
                break
            at += int.from_bytes(head[1], "little") + 1
            if start + at == size:
                return start + m.start()
        else:
            return start + m.start()
    return size


class Members(io.RawIOBase):
    """The text of block gzip from a member on; `at` is where the member begins whose text comes next."""

    def __init__(self, f, at: int):
        self.f, self.at, self.text = f, at, b""
        f.seek(at)

    def member(self) -> bytes | None:
        head = self.f.read(MEMBER_HEAD)
        if not head:
            return None
        m = MEMBER.match(head)
        if m is None:
            raise ValueError(f"no gzip member of known size at byte {self.at}")
        rest = self.f.read(int.from_bytes(m[1], "little") + 1 - MEMBER_HEAD)
        text = zlib.decompress(rest[:-8], -15)
        if zlib.crc32(text) != int.from_bytes(rest[-8:-4], "little"):
            raise ValueError(f"the gzip member at byte {self.at} is damaged")
        self.at += MEMBER_HEAD + len(rest)
        return text

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.text:
            text = self.member()
            if text is None:
                return 0
            self.text = text
        n = min(len(buffer), len(self.text))
        buffer[:n], self.text = self.text[:n], self.text[n:]
        return n

    def close(self) -> None:
        self.f.close()
        super().close()


def texts(path: str, kind: int, start: int, end: int, edges: list[int]) -> Iterator[bytes]:
    """The text of a range, in pieces; at its end, edges are set to where it began and stopped."""
    with raw(path) as f:
        if kind == PLAIN:
            f.seek(start)
            at = start
            while at < end and (piece := f.read(min(1 << 20, end - at))):
                at += len(piece)
                yield piece
            edges[:] = start, at
        elif kind == BLOCKS:
            first = first_member(f, start, end_of(f))
            members = Members(f, first)
            while members.at < end and (piece := members.member()) is not None:
                yield piece
            edges[:] = first, members.at
        else:
            import gzip

            with gzip.GzipFile(fileobj=f) as g:
                while piece := g.read(1 << 20):
                    yield piece
            edges[:] = start, end


def end_of(f) -> int:
    f.seek(0, os.SEEK_END)
    return f.tell()


def lines_from(path: str, kind: int, start: int, skip: int) -> Iterator[str]:
    """The lines of a file after `skip` line breaks of the text that begins with a range."""
    f = raw(path)
    if kind == PLAIN:
        f.seek(start)
        stream = f if isinstance(f, io.BufferedReader) else io.BufferedReader(f, 1 << 20)
    elif kind == BLOCKS:
        stream = io.BufferedReader(Members(f, first_member(f, start, end_of(f))), 1 << 20)
    else:
        import gzip

        stream = gzip.GzipFile(fileobj=f)
    with stream:  # in bytes up to the first wanted line, as a range may begin within a line
        for _ in range(skip):
            stream.readline()
        yield from io.TextIOWrapper(stream, encoding="ascii", newline="\n")


@dataclass
class Ranges:
    """All ranges of all files of both mates, in order: ranges first[f] to first[f + 1] are those of file f."""

    paths: list[str]
    kinds: list[int]
    first: np.ndarray
    file: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, forward: list[str], reverse: list[str], split_bytes: int) -> Ranges:
        paths = [*forward, *reverse]
        kinds, sizes = [kind_of(p) for p in paths], [size_of(p) for p in paths]
        n = len(forward)
        cuts = [1 if WHOLE in kinds[i % n :: n] else max(1, -(-s // split_bytes)) for i, s in enumerate(sizes)]
        first = np.concatenate([[0], np.cumsum(cuts)])
        file = np.repeat(np.arange(len(paths)), cuts)
        start = (np.arange(first[-1]) - first[file]) * split_bytes
        last = np.zeros(len(file), bool)
        last[first[1:] - 1] = True
        return cls(paths, kinds, first, file, start, np.where(last, np.array(sizes)[file], start + split_bytes))


def count_lines(spark: SparkSession, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """For each range its line breaks, and whether its text ends within a line (-1: it has no text). Where a range stops, the
    next one must have begun: else the file is damaged."""
    shared, n = spark.sparkContext.broadcast(ranges), len(ranges.file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                breaks, inside, edges = 0, -1, [0, 0]
                for piece in texts(r.paths[r.file[i]], r.kinds[r.file[i]], int(r.start[i]), int(r.end[i]), edges):
                    if piece:
                        breaks, inside = breaks + piece.count(b"\n"), int(piece[-1] != 10)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (i, breaks, inside, *edges)], names)

    names = ["id", "breaks", "inside", "began", "stopped"]
    found = spark.range(0, n, 1, n).mapInArrow(run, ", ".join(f"{c} long" for c in names)).toArrow().sort_by("id")
    breaks, inside, began, stopped = (found.column(c).to_numpy() for c in names[1:])
    next_ = np.append(began[1:], 0)
    last = ranges.first[1:] - 1
    next_[last] = ranges.end[last]
    for i in np.flatnonzero(stopped != next_)[:1]:
        raise ValueError(f"{ranges.paths[ranges.file[i]]} is damaged: no gzip member of known size at byte {stopped[i]}")
    return breaks, inside


def tasks(ranges: Ranges, breaks: np.ndarray, inside: np.ndarray, n_forward: int, most: int) -> np.ndarray:
    """A row for each range of a first mate that owns records: pair, number of its first record over all files, its records,
    and for each mate the range to begin in and the line breaks to skip (-1, -1 without a second mate)."""
    before, records = np.zeros(len(breaks), np.int64), []
    for a, b in itertools.pairwise(ranges.first):
        sums = np.cumsum(breaks[a:b])
        before[a:b] = sums - breaks[a:b]
        last = inside[a:b][inside[a:b] >= 0]
        records.append((int(sums[-1]) + int(len(last) > 0 and last[-1] == 1)) // 4)
    out, offset = [], 0
    for pair in range(n_forward):
        mates = [pair, pair + n_forward] if len(records) > n_forward else [pair]
        n = min(records[m] for m in mates)
        if most >= 0:
            n = min(n, max(0, most - offset))
        a, b = ranges.first[pair : pair + 2]
        begin = np.where(np.arange(a, b) == a, 0, before[a:b] // 4 + 1)
        stop = np.minimum((before[a:b] + breaks[a:b]) // 4 + 1, n)
        rows = np.flatnonzero(begin < stop)
        columns = [np.full(len(rows), pair), begin[rows] + offset, stop[rows] - begin[rows]]
        for m in (0, 1):
            if m < len(mates):
                lo, hi = ranges.first[mates[m] : mates[m] + 2]
                line = 4 * begin[rows]
                at = lo + np.maximum(np.searchsorted(before[lo:hi], line, "left") - 1, 0)
                columns += [at, line - before[at]]
            else:
                columns += [np.full(len(rows), -1)] * 2
        out.append(np.stack(columns, 1))
        offset += n
    return np.concatenate(out).astype(np.int64)


def read_ranges(spark: SparkSession, ranges: Ranges, n_forward: int, most: int, records: Callable[[Iterator[str], str], Iterator[tuple[str, str]]], schema: str, batch: int) -> DataFrame:
    """The reads of all ranges, one task for each that owns records; `records` makes sequences and qualities of lines."""
    todo = tasks(ranges, *count_lines(spark, ranges), n_forward, most)
    shared = spark.sparkContext.broadcast((ranges, todo))
    names = ["file_idx", "read_idx", "seq1", "qual1", "seq2", "qual2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rows = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                pair, number, n, *places = rows[i].tolist()
                mates = []
                for at, skip in (places[:2], places[2:]):
                    if at >= 0:
                        path = r.paths[r.file[at]]
                        mates.append(records(lines_from(path, r.kinds[r.file[at]], int(r.start[at]), skip), path))
                    else:
                        mates.append(itertools.repeat((None, None)))
                both = itertools.islice(zip(*mates), n)  # noqa: B905
                while chunk := list(itertools.islice(both, batch)):
                    (s1, q1), (s2, q2) = (zip(*m, strict=True) for m in zip(*chunk, strict=True))
                    ids = [pa.array([pair] * len(chunk), pa.int32()), pa.array(range(number, number + len(chunk)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.string()) for c in (s1, q1, s2, q2))], names)
                    number += len(chunk)

    return spark.range(0, len(todo), 1, max(1, len(todo))).mapInArrow(run, schema)
