"""Exact substring dedup by suffix arrays.

Every byte that a 100-byte string covers which also starts earlier (in a smaller document id, or earlier in the same
document) is removed; strings are judged on the input. Matches never cross documents.

Equal windows of 100 bytes have equal content-defined anchors (`anchors`), which tell where windows must meet:

1. the anchors of each document are listed once; those that occur once in the corpus are set aside (pre-aggregated counts);
2. a task lays the marked windows of its documents out in chunks, whose suffix arrays (two-stage sorting, then adjacent
   common prefixes) show the windows that repeat inside the chunk: those are removed, and only the first of each goes on, so
   that a group of copies, however large, sends one segment a chunk;
3. segments of different chunks meet at their anchor in further chunks of whole anchors, sorted in the same way;
4. an anchor with more than MOST segments is split first: each window is dealt by the anchor and what stands beside it, on the
   side that has more of the window, half of the rest at a time. Equal windows stay together, groups shrink, and the sorting is
   the same. A group that shares all of its 100 bytes holds one window a chunk; its first is found by a pre-aggregated minimum.

Joins on hot keys are joins of two plain exchanges, which adaptive execution splits. Filters of fixed size keep documents
without marks out of the shuffles of texts; where they are full, they only pass more.

Defined cases: a null text counts as empty; documents with a null id take no part and keep all bytes; rows that repeat an
id with equal texts count as one document; where texts of one id differ, equal strings of both at one start don't remove
each other; texts shorter than the span keep all bytes; bytes are cut even within characters; texts of any length are worked
on in pieces; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common, suffixes
from .anchors import GRAM, SPAN

#: Segments of a group that are sorted together.
MOST = 4096
#: Bytes of segments that are sorted together: the arrays take about a hundred times that.
CHUNK_BYTES = 1 << 20
ROWS = 2048
SEGMENT = "key long, id long, a int, b int, f int, bytes binary"
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
NAMES = ["key", "id", "a", "b", "f", "bytes"]


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SEGMENT. With a key: the windows from a to b (places of their first bytes), their bytes, and the place in there
    of what they share, the key. Without: a range of bytes to remove."""
    columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def listed(base: DataFrame) -> DataFrame:
    """id and the hashes of all anchors of each text, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, ROWS, anchors.PIECE):
                for rows, _, parts in anchors.pieces(b.column(1).to_pylist()):
                    part, h, *_ = anchors.runs(parts)
                    edges = np.searchsorted(part, np.arange(len(parts) + 1))
                    hs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), hs], ["id", "hs"])

    return common.cut(base.mapInArrow(common.tidy(run, anchors.forget), "id long, hs array<long>"), "anchors")


def marked(base: DataFrame) -> DataFrame:
    """id, text, hs: the texts with anchors that occur more than once, and these anchors."""
    every = listed(base)
    one = every.select("id", F.explode("hs").alias("h"))
    again = common.cut(one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    found = common.maybe_in(one, "h", common.bloom(again, "h"), "_again").where("_again").select("id", "h")
    found = common.cut(found.join(again.hint("merge"), "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias("hs")), "marked")
    for x in (every, again):
        common.discard(x)
    near = common.maybe_in(base, "id", common.bloom(found, "id"), "_marked").where("_marked").select("id", "text")
    return near.join(found.hint("merge"), "id")


def local(docs: DataFrame) -> DataFrame:
    """Ranges that repeat within a chunk of marked windows, and the segments of all other marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, list[tuple[int, int, int, int]]]] = []  # id, place, bytes, runs (h, anchor, first, last)
        size = 0

        def flush() -> pa.RecordBatch:
            """What repeats in the chunk can only be where an anchor does: those runs are sorted, the others go on as they are."""
            names, n = np.unique(np.array([r[0] for x in held for r in x[3]], np.int64), return_counts=True)
            twice = set(names[n > 1].tolist())
            out: list[tuple] = []
            near: list[tuple[int, int, bytes, list[tuple[int, int, int, int]]]] = []
            for id_, place, raw, own in held:
                i = 0
                while i < len(own):
                    h, anchor, first, last = own[i]
                    i += 1
                    if h not in twice:
                        out.append((h, id_, place + first, place + last, anchor - first, raw[first : last + SPAN]))
                        continue
                    j = i
                    while j < len(own) and own[j][0] in twice:
                        j += 1
                    near.append((id_, place + first, raw[first : own[j - 1][3] + SPAN], [(h, anchor - first, a - first, z - first) for h, anchor, a, z in own[i - 1 : j]]))
                    i = j
            part, at = suffixes.repeats([x[2] for x in near], *(np.array([x[i] for x in near], np.int64) for i in (0, 1)), SPAN) if near else (np.zeros(0, np.int64), None)
            edges = np.searchsorted(part, np.arange(len(near) + 1))
            for i, (id_, place, raw, own) in enumerate(near):
                if edges[i] == edges[i + 1]:
                    out += [(h, id_, place + a, place + z, anchor - a, raw[a : z + SPAN]) for h, anchor, a, z in own]
                    continue
                gone = np.zeros(len(raw) - SPAN + 2, bool)
                gone[at[edges[i] : edges[i + 1]]] = True
                step = np.flatnonzero(np.diff(np.append(False, gone).astype(np.int8)))
                for s, e in zip(*(x.tolist() for x in union(step[::2], step[1::2] - 1 + SPAN)), strict=True):  # touching ranges are one
                    out.append((None, id_, place + s, place + e, None, None))
                upto = np.append(0, np.cumsum(gone)).tolist()
                for h, anchor, first, last in own:
                    lost = upto[last + 1] - upto[first]
                    if not lost:
                        out.append((h, id_, place + first, place + last, anchor - first, raw[first : last + SPAN]))
                    elif lost <= last - first:
                        step = np.flatnonzero(np.diff(np.concatenate([[True], gone[first : last + 1], [True]]).astype(np.int8)))
                        for s, e in zip((first + step[::2]).tolist(), (first + step[1::2] - 1).tolist(), strict=True):
                            out.append((h, id_, place + s, place + e, anchor - s, raw[s : e + SPAN]))
            return _segments(out)

        for whole in batches:
            for b in common.slices(whole, ROWS, anchors.PIECE):
                ids = b.column(0).to_pylist()
                wanted = [np.array(x, np.int64) for x in b.column(2).to_pylist()]
                for rows, places, parts in anchors.pieces(b.column(1).to_pylist()):
                    part, h, anchor, first, last = anchors.runs(parts)
                    keep = np.isin(h.view(np.int64), np.concatenate([wanted[r] for r in dict.fromkeys(rows)]))
                    part, h, anchor, first, last = (x[keep].tolist() for x in (part, h.view(np.int64), anchor, first, last))
                    i = 0
                    while i < len(part):  # neighbouring runs make one segment
                        j = i + 1
                        while j < len(part) and part[j] == part[i] and first[j] <= last[j - 1] + 1:
                            j += 1
                        p, s = part[i], first[i]
                        raw = parts[p][s : last[j - 1] + SPAN]
                        held.append((ids[rows[p]], places[p] + s, raw, [(h[k], anchor[k] - s, first[k] - s, last[k] - s) for k in range(i, j)]))
                        size += len(raw)
                        i = j
                        if size >= CHUNK_BYTES:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    return common.cut(docs.select("id", "text", "hs").mapInArrow(common.tidy(run, anchors.forget), SEGMENT), "segments")


def compared(segments: DataFrame) -> DataFrame:
    """Ranges of windows that repeat, from suffix arrays of chunks that hold all segments of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # id, place, bytes
        group: list[tuple] = []
        size = 0
        names = ["id", "a", "b"]

        def ranges(doc, start, end) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names)

        def flush() -> pa.RecordBatch:
            ids, places = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
            part, at = suffixes.repeats([x[2] for x in held], ids, places, SPAN)
            doc, start = ids[part], places[part] + at
            by = np.lexsort((start, doc))
            doc, start = doc[by], start[by]
            new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + SPAN)) if len(doc) else np.zeros(0, bool)
            last = np.append(new[1:], True) if len(doc) else new
            return ranges(doc[new], start[new], start[last] + SPAN)

        again: list[tuple[int, int, int]] = []

        def ended() -> None:
            """Of equal segments the first is compared with the others; the later ones repeat it as a whole."""
            nonlocal size
            first: dict[bytes, tuple[int, int]] = {}
            for _, id_, a, raw in group:
                known = first.get(raw)
                if known is None or (id_, a) < known:
                    first[raw], known = (id_, a), known
                elif (id_, a) == known:
                    continue
                else:
                    known = (id_, a)
                if known is not None:
                    again.append((known[0], known[1], known[1] + len(raw)))
            if len(first) > 1:
                held.extend((*at, raw) for raw, at in first.items())
                size += sum(map(len, first))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:  # else no other segment has its anchor
                        ended()
                    group = []
                    if size >= CHUNK_BYTES:
                        yield flush()
                        held, size = [], 0
                group.append(row)
            if again:
                yield ranges(*zip(*again, strict=True))
                again = []
        if len(group) > 1:
            ended()
        if again:
            yield ranges(*zip(*again, strict=True))
        if held:
            yield flush()

    return segments.select("key", "id", "a", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(common.tidy(run), "id long, a int, b int")


def deeper(segments: DataFrame, shared: int) -> tuple[DataFrame, int]:
    """The segments, whose windows share `shared` bytes, dealt by more of what their windows share, and how much that is."""
    need = (SPAN - shared + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 8192):
                out = []
                for key, id_, a, z, f, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    n = z - a + 1
                    turn = min(n, max(0, f + shared + need - SPAN))  # the first window with so much on the right
                    for s, e, at in ((0, turn, f - need), (turn, n, f)):
                        if e > s:
                            side = b"l" if at < f else b"r"
                            mine = xxhash.xxh64_intdigest(side + raw[at : at + shared + need], key & 0xFFFFFFFF)
                            out.append((mine - (1 << 64) if mine >> 63 else mine, id_, a + s, a + e - 1, at - s, raw[s : e - 1 + SPAN]))
                yield _segments(out)

    return segments.mapInArrow(run, SEGMENT), shared + need


def removed_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and parallel lists a, b: ranges of bytes to remove, which may overlap. All other tables are deleted on return."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    own = local(marked(base))
    ranges = [own.where("key IS NULL").select("id", "a", "b")]
    segments, shared, tables = own.where("key IS NOT NULL"), GRAM, [own]
    while True:
        many = common.cut(segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key"), "many")
        # few keys (at most a row for each MOST segments), which Spark broadcasts where it finds them small: the segments stay put
        if many.isEmpty():
            ranges.append(compared(segments))
            break
        ranges.append(compared(segments.join(many, "key", "left_anti")))
        hot = segments.join(many, "key", "left_semi").select(NAMES)
        if shared == SPAN:  # one window a row, all bytes of which a group shares
            hot = common.cut(hot, "equal-windows")
            tables.append(hot)
            first = hot.groupBy("key", "bytes").agg(F.min(F.struct("id", "a")).alias("first"))
            ranges.append(hot.join(first.hint("merge"), ["key", "bytes"]).where("id <> first.id OR a <> first.a").select("id", "a", (F.col("b") + SPAN).alias("b")))
            break
        dealt, shared = deeper(hot, shared)
        segments = common.cut(dealt, "deeper-segments")
        tables.append(segments)
    out = common.cut(reduce(DataFrame.unionByName, ranges).groupBy("id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "ranges")
    for x in tables:
        common.discard(x)
    return out


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, separate ranges with the same bytes."""
    if not len(a):
        return a, b
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(new[1:], True)]


def cut_out(raw: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    edges = [0, *(x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair), len(raw)]
    return b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes, their maximal runs, and the SHA-256 of what is left."""
    ranges = removed_ranges(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col), F.col(id_col).cast("long").alias("_x_id"), F.col(text_col).alias("_x_text"))
    own = common.maybe_in(own, "_x_id", common.bloom(ranges, "id"), "_x_cut")
    none = F.lit(None).cast("array<int>")
    whole = own.where("NOT _x_cut").select(id_col, "_x_text", none.alias("a"), none.alias("b"))
    joined = own.where("_x_cut").join(ranges.withColumnRenamed("id", "_x_id").hint("merge"), "_x_id", "left").select(id_col, "_x_text", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for whole in batches:
            for part in common.slices(whole, ROWS, anchors.PIECE):
                rows = []
                for t, a, b in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    a, b = union(np.array(a or [], np.int64), np.array(b or [], np.int64))
                    rows.append((len(raw), int((b - a).sum()), len(a), common.sha256_hex(cut_out(raw, a, b))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names)

    return whole.unionByName(joined).mapInArrow(common.tidy(run), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(length(hx) // 2 - 99, 0))) AS p, unnest(list_transform(range(0, greatest(length(hx) // 2 - 99, 0)), lambda p: md5(substr(hx, CAST(2 * p + 1 AS INT), 200)))) AS g FROM d),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1 AS again FROM w),
b AS (SELECT doc_id, unnest(range(0, length(hx) // 2)) AS p, unnest(list_transform(range(0, length(hx) // 2), lambda p: substr(hx, CAST(2 * p + 1 AS INT), 2))) AS h FROM d),
m AS (SELECT b.doc_id, b.p, h, coalesce(max(CASE WHEN again THEN b.p END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS UNBOUNDED PRECEDING) >= b.p - 99, false) AS gone FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.p = b.p),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM m),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(h, '' ORDER BY p) FILTER (NOT gone) AS k FROM s GROUP BY doc_id)
SELECT doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
