"""Near and exact dedup against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mavelake.llm import anchors, exactdup, neardup, suffixes
from mavelake.llm.common import table
from mavelake.llm.shingles import bags, word_hashes

from ..helpers import same


def brute_pairs(docs, threshold=0.8):
    """All pairs of documents whose weighted Jaccard similarity reaches the threshold, from the words themselves."""
    sets = []
    for _, t in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(x for s in sets for x in s)
    least = max(2, 0.01 * len(docs), sum(map(len, sets)) / 2**19)
    weights = [{x: n * math.log1p(len(docs) / max(df[x], least)) for x, n in s.items()} for s in sets]
    totals = [sum(x.values()) for x in weights]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    out = []
    for i, own in enumerate(weights):
        common = defaultdict(float)
        for x, w in own.items():
            for j in where[x]:
                if j > i:
                    common[j] += min(w, weights[j][x])
        out += [(docs[i][0], docs[j][0]) for j, m in common.items() if m / (totals[i] + totals[j] - m) >= threshold]
    return out


def brute_classes(docs, threshold=0.8):
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for a, b in brute_pairs(docs, threshold):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in parent}


def test_near_duplicates(spark, sf_dir):
    """Recall of pairs at the threshold, and the classes, on a thousand documents."""
    sf = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else sf_dir
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    pairs, want = brute_pairs(rows), brute_classes(rows)
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))


def test_frequencies_are_exact(spark):
    """What is in a hundredth of the documents is counted exactly; what is rarer weighs as if it were."""
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(40))
    texts = [f"{common if i % 7 == 0 else ''} {' '.join(f'w{rng.randrange(50)}' for _ in range(80))}" for i in range(300)] + [None, ""]
    idf = neardup.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = Counter(h for t in texts for h in bags([t])[1].tolist())
    h = np.array(sorted(df), np.uint64)
    assert idf.least == 0.01 * len(texts) and np.allclose(idf.of(h), [math.log1p(len(texts) / max(df[x], idf.least)) for x in h.tolist()])
    assert neardup.frequencies(spark.createDataFrame([], "text string")).of(h[:3]).shape == (3,)


def test_words_of_long_texts():
    """Hashes don't depend on how a buffer is cut into pieces."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c.éX") for _ in range(n)) for n in (0, 1, 50, 3000)] + [None, "x" * 500, " " * 300]
    for piece in (20, 77, 1000):
        for x, y in zip(word_hashes(texts, piece), word_hashes(texts), strict=True):
            assert (x == y).all()


def test_near_duplicate_groups(spark, monkeypatch):
    """Large groups of copies and near copies, and edge cases."""
    monkeypatch.setattr(neardup, "GROUP", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]

    def near(k):
        x = list(base)
        x[rng.randrange(150)] = f"edit{k}"
        return " ".join(x)

    rows = [(i, near(i)) for i in range(80)] + [(100 + i, "same text of some words here") for i in range(60)] + [(200, None), (201, ""), (202, "..."), (203, ""), (300, "two words"), (301, "Two, WORDS!"), (302, "x " * 20000), (303, " ".join(f"u{i}" for i in range(20000)))]
    rows += [(400 + i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(20)] + [(None, "same text of some words here"), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, id int, class string")
    out = neardup.classes(df).collect()
    got = {r.doc_id: r.class_id for r in out}
    assert len(out) == len(rows) and got[None] is None
    assert all(got[i] == 0 for i in range(80)) and all(got[100 + i] == 100 for i in range(60)) and got[301] == 300
    assert all(got[i] == i for i in (200, 201, 202, 203, 302, 303, *range(400, 420)))
    assert neardup.classes(df.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in neardup.keep_one(df).collect() if r.doc_id is not None)
    assert kept == [0, 100, 200, 201, 202, 203, 300, 302, 303, *range(400, 420)]


def hub_group(copies, seed):
    """A text and copies that are each similar to it, at about 0.82, but not to each other, among nine times as many others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, copies + 1):
        x, at = list(base), rng.randrange(4, 138)
        x[at : at + 6] = [f"edit{k}x{i}" for i in range(6)]
        rows.append((k, " ".join(x)))
    return rows + [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))) for k in range(copies + 1, 10 * copies)]


def test_hub_of_several_parts(spark, monkeypatch):
    """Copies whose only partner is in another part of the bucket."""
    monkeypatch.setattr(neardup, "GROUP", 16)
    rows = hub_group(120, 4)
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {want[i] for i in range(121)} == {0} and got == want


def test_hub_among_false_pairs(spark):
    """Copies whose one true pair is estimated lower than many false ones, in buckets of more than GROUP members."""
    rows = hub_group(400, 5)
    pairs, want = brute_pairs(rows), brute_classes(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {want[i] for i in range(401)} == {0} and sum(got[i] != want[i] for i in range(401)) <= 4
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)


def test_similarities_are_exact():
    """The matrix product against sets, for texts of few and of many shingles and repeated ones."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(4)}" for _ in range(rng.choice([3, 30, 300]))) for _ in range(40)] + ["", "x y", "X, y!"]
    n = len(texts)
    bag = [dict(zip(h.tolist(), c.tolist(), strict=True)) for _, h, c, _ in (bags([t]) for t in texts)]
    df = Counter(h for b in bag for h in b)
    names = np.array(sorted(df), np.uint64)
    idf = neardup.Idf(float(n), 1.0, np.ones(neardup.WIDTH, bool), names, np.array([df[int(x)] for x in names], float))
    w = {int(x): float(y) for x, y in zip(names, idf.of(names), strict=True)}
    got = neardup.similarities(texts, idf)
    for i in range(n):
        for j in set(range(n)) - {i}:
            least = sum(min(c, bag[j].get(h, 0)) * w[h] for h, c in bag[i].items())
            both = sum(c * w[h] for b in (bag[i], bag[j]) for h, c in b.items())
            assert abs(got[i, j] - (least / (both - least) if both else 0)) < 1e-6


def test_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.choice(2**52, 400, replace=False)).astype(np.uint64)
    b = np.sort(np.append(a[:360], rng.choice(2**52, 40))).astype(np.uint64)
    s = neardup.Sampler(400, seed=2)
    x, y = (s.of(h, np.full(400, 1.5, np.float32), np.array([0])) for h in (a, b))
    assert abs((x == y).mean() - 360 / 440) < 0.07


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["class"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    """Links of blocks are mostly stars: these are seen to be done from the least neighbours alone, and a path
    of three takes one round."""
    written = []
    cut = neardup.common.cut
    monkeypatch.setattr(neardup.common, "cut", lambda df, label: written.append(label) or cut(df, label))
    stars = [(9, 1), (8, 1), (1, 7), (9, 1), (30, 20), (5, 5)]
    got = sorted(map(tuple, neardup.components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert got == [(1, 1), (7, 1), (8, 1), (9, 1), (20, 20), (30, 20)] and written == ["links", "least"]
    written.clear()
    got = sorted(map(tuple, neardup.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()))
    assert got == [(1, 1), (2, 1), (3, 1)] and written == ["links", "least", "large", "low", "stars", "least"]
    assert neardup.components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []


def brute_removed(rows, span=100):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            if w in seen:
                mask[p : p + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        out[i] = (len(b), sum(mask), sum(mask[j] and (j == 0 or not mask[j - 1]) for j in range(len(mask))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most,chunk", [(4096, 1 << 20), (4096, 3000), (2, 1000)])
def test_exact_substrings(spark, sf_dir, most, chunk, monkeypatch):
    """Against brute force: as in production; with chunks that hold few segments; and with all large groups split to the end."""
    monkeypatch.setattr(exactdup, "MOST", most)
    monkeypatch.setattr(exactdup, "CHUNK_BYTES", chunk)
    docs = table(spark, sf_dir, "documents")
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(230))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    if chunk < 1 << 20:
        rows = rows[:60]
    rows += [(10_000 + i, f"{rng.random()} {passage[rng.randrange(60):]} {rng.random()}") for i in range(12)] + [(20_000, None), (20_001, ""), (20_002, "ab" * 400), (20_003, "x" * 99), (20_004, "x" * 300), (20_005, passage * 3), (None, passage)]
    rows += [(30_000 + i, f"{rng.random():.17f}" * 6 + passage[40:110] + f"{rng.random():.17f}" * 6) for i in range(12)]  # share less than a window
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exactdup.digests(df).collect()}
    none = got.pop(None)
    assert got == brute_removed(rows) and none[1] == 0
    assert exactdup.digests(df.limit(0)).count() == 0


def test_exact_substrings_sql(spark, duck, sf_dir):
    same(exactdup.digests(table(spark, sf_dir, "documents")).toPandas(), duck.sql(exactdup.ORACLE_SQL).df())


def test_exact_substrings_repeated_rows(spark):
    """Rows that repeat an id with its text count as one document."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(500))
    rows = [(1, text), (1, text), (2, "z" + text[100:400]), (2, "z" + text[100:400])]
    out = exactdup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in out) == [(1, 0, 0), (1, 0, 0), (2, 300, 1), (2, 300, 1)]


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in range(80):
        segs = [bytes(rng.integers(97, 98 + n % 4, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        codes, _ = suffixes.encode(segs)
        order, left = suffixes.suffix_array(codes), suffixes.left_in_segment(codes)
        assert list(order) == sorted(range(len(codes)), key=lambda i: (tuple(codes[i : i + left[i] + 1]), i + left[i]))  # noqa: B023
        lcp = suffixes.common_prefixes(order, suffixes.keys(codes), codes, left, 15)
        for j in range(1, len(order)):
            a, b, k = order[j - 1], order[j], 0
            while k < 15 and codes[a + k] == codes[b + k] > 0:
                k += 1
            assert k == lcp[j]


def test_repeats_by_neighbours_alone(monkeypatch):
    """Strings that repeat are told by whether neighbours agree in a span: no whole common prefix is measured for that."""

    def brute(segs, doc, place, span):
        every = sorted((d, p + k, i, k) for i, (s, d, p) in enumerate(zip(segs, doc, place, strict=True)) for k in range(len(s) - span + 1))
        first, out = {}, []
        for d, p, i, k in every:
            if first.setdefault(segs[i][k : k + span], (d, p)) != (d, p):
                out.append((i, k))
        return sorted(out)

    rng = np.random.default_rng(4)
    for span in (5, 7, 14, 20):
        with monkeypatch.context() as m:
            if span >= suffixes.STEP:
                m.setattr(suffixes, "common_prefixes", None)
            for n in range(25):
                segs = [bytes(rng.integers(97, 98 + n % 3, rng.integers(1, 90)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
                doc, place = np.sort(rng.integers(0, 4, len(segs))), np.arange(len(segs)) * 100
                got = suffixes.repeats(segs, doc, place, span)
                assert list(zip(*(x.tolist() for x in got), strict=True)) == brute(segs, doc.tolist(), place.tolist(), span)


def test_anchors_meet():
    rng = random.Random(4)
    common = "".join(rng.choice("abcd") for _ in range(150))
    texts = ["x" * 37 + common + "yy", common + "zzz", "q", None, "short"]
    (rows, places, parts), *_ = anchors.pieces(texts)
    text, h, anchor, first, last = anchors.runs(parts)
    for t, s in ((0, 37), (1, 0)):
        k = (text == t) & (first <= s + 50) & (last >= s)
        assert k.any()
    found = [{(int(x), int(a - f)) for x, a, lo, hi, u in zip(h, anchor, first, last, text, strict=True) if u == t for f in range(lo, hi + 1)} for t in (0, 1)]
    assert len(found[0] & found[1]) >= 51


def test_pieces_hold_every_window_once():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé") for _ in range(n)) for n in (0, 5, 99, 100, 101, 350, 2000)] + [None]
    seen = []
    for rows, places, parts in anchors.pieces(texts, 150):
        assert sum(map(len, parts)) <= 150 + anchors.SPAN
        for r, at, raw in zip(rows, places, parts, strict=True):
            assert (texts[r] or "").encode()[at : at + len(raw)] == raw
            seen += [(r, at + s) for s in range(len(raw) - anchors.SPAN + 1)]
        text, _, anchor, first, last = anchors.runs(parts)
        assert ((first <= last) & (anchor >= last) & (anchor <= first + anchors.WINDOW - 1)).all()
    assert sorted(seen) == [(r, s) for r, t in enumerate(texts) for s in range(len((t or "").encode()) - anchors.SPAN + 1)]
