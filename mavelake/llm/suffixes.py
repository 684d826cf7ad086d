"""Suffix arrays by two-stage sorting, with numpy over whole buckets.

Segments of bytes become one array of codes 1 .. 256, each closed by the code 0. A suffix is of the small kind if it is
smaller than its successor, else of the large kind. Only the small ones are sorted directly. One scan over the buckets of
first codes then induces all large ones: the predecessor of each suffix, met in order, joins the large part of its bucket.
Closing codes count as ordered by place, so suffixes that agree to their segment's end are in order of place.
"""

from __future__ import annotations

import numpy as np

STEP = 7  # codes of nine bits in a 64-bit key


def encode(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the segments and where each begins."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.zeros(starts[-1], np.int16)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    codes[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    return codes, starts[:-1]


def keys(codes: np.ndarray) -> np.ndarray:
    """The next STEP codes from each place on, as one number; nothing counts after a closing code."""
    padded = np.append(codes, np.zeros(STEP, codes.dtype))
    out = np.zeros(len(codes), np.int64)
    inside = np.ones(len(codes), bool)
    for k in range(STEP):
        code = padded[k : k + len(codes)]
        inside &= code > 0
        out = out << 9 | np.where(inside, code, 0)
    return out


def left_in_segment(codes: np.ndarray) -> np.ndarray:
    """How many codes follow from each place on before the closing one."""
    ends = np.flatnonzero(codes == 0)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(codes))


def _sort_small(small: np.ndarray, key: np.ndarray, left: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places of the small suffixes in suffix order, refined STEP codes at a time where they tie, up to `most` codes."""
    own = key[small]
    by = np.argsort(own)
    value = own[by]
    group = np.cumsum(np.append(0, value[1:] != value[:-1]))
    depth = STEP
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)  # these by place: an unstable sort and one of numbers take less than a stable one
    by[tied] = np.sort(group[tied] << 32 | by[tied]) & 0xFFFFFFFF
    order = small[by]
    active = np.flatnonzero((size[group] > 1) & (left[order] >= depth))
    while len(active) and (most is None or depth < most):
        at = order[active]
        g, v = group[active], key[np.minimum(at + depth, len(key) - 1)]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        count = np.diff(np.append(start, len(g)))
        first = start[count == 2]  # most groups are pairs
        first = first[v[first] > v[first + 1]]
        by = np.arange(len(g))
        by[first], by[first + 1] = first + 1, first
        more = np.flatnonzero(np.repeat(count > 2, count))
        by[more] = more[np.lexsort((v[more], g[more]))]
        order[active], v = at[by], v[by]
        # ties of a group are neighbours again; those of other groups stay apart
        new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
        run = np.cumsum(new) - 1
        depth += STEP
        many = np.bincount(run)[run] > 1
        group[active] = active[np.flatnonzero(new)][run]
        active = active[many & (left[order[active]] >= depth)]
    return order


def suffix_array(codes: np.ndarray, key: np.ndarray | None = None, left: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Places of all suffixes in order; with `most`, in order of their first `most` codes at least. (What is induced is at
    least as well ordered as what it is induced from.)"""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    key = keys(codes) if key is None else key
    left = left_in_segment(codes) if left is None else left
    differs = np.append(np.flatnonzero(codes[1:] != codes[:-1]), n - 1)
    after = np.repeat(differs, np.diff(differs, prepend=-1)) + 1
    small = (codes == 0) | (np.append(codes, 0)[after] > codes)
    ordered = _sort_small(np.flatnonzero(small), key, left, most)
    edges = np.searchsorted(codes[ordered], np.arange(258))
    large: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        wave = np.concatenate(large[c]) if large[c] else np.zeros(0, np.int64)
        bucket = [wave]
        while len(wave):  # large suffixes of the same bucket, induced in turn
            wave = wave[wave > 0] - 1
            wave = wave[codes[wave] == c]
            bucket.append(wave)
        bucket.append(ordered[edges[c] : edges[c + 1]])
        scan = np.concatenate(bucket)
        out.append(scan)
        before = scan[scan > 0] - 1
        before = before[codes[before] > c]
        if len(before):
            first = codes[before]
            by = np.argsort(first.astype(np.int16), kind="stable")  # sixteen bits are sorted by counting
            first, before = first[by], before[by]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for part, code in zip(np.split(before, cuts[1:]), first[cuts], strict=True):
                large[code].append(part)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, key: np.ndarray, codes: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Common prefix within their segments of each suffix and the one before it in order, up to `most`; 0 for the first."""
    a, b = order[:-1], order[1:]
    length = np.zeros(len(order), np.int64)
    live = np.arange(len(a))
    depth = 0
    last = len(codes) - 1
    while len(live) and depth + STEP <= most:
        x, y = a[live] + depth, b[live] + depth
        same = (np.maximum(x, y) <= last) & (key[np.minimum(x, last)] == key[np.minimum(y, last)])
        length[live[same] + 1] += STEP
        ended, live = live[~same], live[same]
        for k in range(STEP):  # the codes that still agree
            x, y = a[ended] + depth + k, b[ended] + depth + k
            go = (np.maximum(x, y) <= last) & (codes[np.minimum(x, last)] == codes[np.minimum(y, last)])
            ended = ended[go]
            length[ended + 1] += 1
        depth += STEP
    while len(live) and depth < most:
        x, y = a[live] + depth, b[live] + depth
        live = live[(np.maximum(x, y) <= last) & (codes[np.minimum(x, last)] == codes[np.minimum(y, last)])]
        length[live + 1] += 1
        depth += 1
    length[1:] = np.minimum(length[1:], np.minimum(left[a], left[b]))
    return length


def agree(order: np.ndarray, key: np.ndarray, span: int) -> np.ndarray:
    """Whether each suffix has a common prefix of at least `span` codes with the one before it in order; false for the first.
    All suffixes have so many codes left. Codes are compared STEP at a time, and most neighbours differ in the first few."""
    out = np.zeros(len(order), bool)
    a, b, live = order[:-1], order[1:], np.arange(1, len(order))
    for depth in [*range(0, span - STEP, STEP), span - STEP]:  # the last two steps may overlap
        same = key[a + depth] == key[b + depth]
        a, b, live = a[same], b[same], live[same]
    out[live] = True
    return out


def repeats(segments: list[bytes], doc: np.ndarray, place: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and start in there of every span-byte string of the segments that also starts earlier: in a smaller doc, or at
    a smaller place of the same; in order. Segment i stands at place[i] of doc[i]."""
    codes, starts = encode(segments)
    key, left = keys(codes), left_in_segment(codes)
    order = suffix_array(codes, key, left, span)
    order = order[left[order] >= span]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(~agree(order, key, span) if span >= STEP else common_prefixes(order, key, codes, left, span) < span)
    many = np.bincount(group)[group] > 1
    order, group = order[many], group[many]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    segment = np.searchsorted(starts, order, "right") - 1
    d, p = doc[segment], place[segment] + order - starts[segment]
    by = np.lexsort((p, d, group))
    order, segment, d, p, group = (x[by] for x in (order, segment, d, p, group))
    again = np.append(False, group[1:] == group[:-1])
    first = np.flatnonzero(~again)
    head = first[np.cumsum(~again) - 1]
    again &= (d != d[head]) | (p != p[head])  # the same place may be in two segments
    by = np.argsort(order[again])
    return segment[again][by], (order - starts[segment])[again][by]
