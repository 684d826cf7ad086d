"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are maximal runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. The automaton holds every
substring of the items; a document's words are streamed through it while the longest matching length is tracked. Where it
reaches the window length, or the whole of an item shorter than a window, those words are hit.

The items are read in blocks of a checked size. A block's automaton is built once, on the driver, in flat arrays (28 bytes a
state and what branching needs, about ten times the text) and broadcast; a worker holds one. With more than one block, each
further block is one pass that returns the hits of the texts it hits alone, named by a digest of the text; these join the
first pass, so no text is written or rewritten between the passes.

Defined cases: null and empty texts have no words and no hits; items without words match nothing; items with a null id
take no part; repeated items and repeated ids count once; documents of any length are streamed whole; an empty table of
items hits nothing; columns of df that `find` and `digests` name an output column after are replaced, and `clean` keeps all
columns of df, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Most bytes of item text in one automaton.
BLOCK_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class ItemAutomaton:
    """All substrings of the items, with the states that end a window or a whole short item.

    A state's first transition is in two flat arrays; `more` has the others, by state and word."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.id_of: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {0: {}}
        self.length, self.link = array("i", [0]), array("i", [-1])
        known = [(name, array("i", [self.id_of.setdefault(w, len(self.id_of)) for w in ws])) for name, ws in items if ws]
        for _, ids in known:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        n = len(self.to)
        self.items: dict[int, set[str]] = {}  # of the window, or the short item, that ends at a state
        self.short = array("i", bytes(4 * n))  # length of the short item that ends here
        for name, ids in known:
            v = 0
            for i, c in enumerate(ids):
                v = self._next(v, c)
                if i + 1 >= window:
                    self.items.setdefault(self._of_window(v), set()).add(name)
            if len(ids) < window:
                self.short[v] = len(ids)
                self.items.setdefault(v, set()).add(name)
        #: The nearest state above, by suffix links, that ends a short item; and the least length at which a state hits.
        self.above, self.least = array("i", bytes(4 * n)), array("i", [window]) * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.above[v] = up if self.short[up] else self.above[up]
            if self.above[v]:
                self.least[v] = 0
            elif self.short[v]:
                self.least[v] = self.short[v]

    def _next(self, v: int, c: int) -> int:
        """The state after v and a word; -1 if there is none."""
        if self.word[v] == c:
            return self.to[v]
        m = self.more.get(v)
        return -1 if m is None else m.get(c, -1)

    def _put(self, v: int, c: int, to: int) -> None:
        if self.word[v] in (c, -1) and v:  # the root has all words, in `more`
            self.word[v], self.to[v] = c, to
        else:
            self.more.setdefault(v, {})[c] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(0)
        self.length.append(length)
        self.link.append(link)
        return len(self.to) - 1

    def _extend(self, last: int, c: int) -> int:
        length, link = self.length, self.link
        q = self._next(last, c)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0 and self._next(p, c) < 0:
            self._put(p, c, new)
            p = link[p]
        if p >= 0:
            q = self._next(p, c)
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that are no longer than p's longest plus one word."""
        new = self._state(self.length[p] + 1, self.link[q])
        self.word[new], self.to[new] = self.word[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._next(p, c) == q:
            self._put(p, c, new)
            p = self.link[p]
        return new

    def _of_window(self, v: int) -> int:
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first, end), in order of their ends, and the items whose windows occur."""
        first, to_, more, length, link, least, window = self.word, self.to, self.more, self.length, self.link, self.least, self.window
        root, none = more[0], {}
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = matched = 0
        for i, c in enumerate(map(self.id_of.get, ws)):
            if c is None:
                v = matched = 0
                continue
            while v:
                if first[v] == c:
                    v = to_[v]
                    break
                if v in more and (to := more.get(v, none).get(c)) is not None:
                    v = to
                    break
                v = link[v]
                matched = length[v]
            else:
                v, matched = root[c], 0  # the root has every known word
            matched += 1
            if matched >= least[v]:
                if matched >= window:
                    found.add(self._of_window(v))
                    spans.append((i + 1 - window, i + 1))
                u = v if self.short[v] and matched >= self.short[v] else self.above[v]
                while u:
                    found.add(u)
                    spans.append((i + 1 - self.short[u], i + 1))
                    u = self.above[u]
        return spans, set().union(*(self.items[u] for u in found)) if found else set()


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, nor what stands between those of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    where = [m.span() for m in WORD.finditer(raw.translate(FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : where[a][0]])
        at = where[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    block: list[tuple[str, str]] = []
    held = 0
    for name, text in rows.toLocalIterator():
        size = len(text.encode("utf-8", "surrogatepass"))
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += size
    yield block


#: Names of the columns that are added: unlikely in a caller's table.
WORDS, SPANS, ITEMS, DIGEST = "_dc_n_words", "_dc_spans", "_dc_items", "_dc_digest"
SPAN_KIND, ITEM_KIND = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def _scanned(df: DataFrame, automaton: ItemAutomaton, text_col: str, kept: list[str], more: bool = False, max_coverage: float | None = None) -> DataFrame:
    """The columns kept of df, the number of words, the hit spans (flat) and the items that occur; with max_coverage, the
    columns kept alone, without the hit spans in the text, of rows that aren't hit more than that. With more, df has the
    columns SPANS and ITEMS of earlier passes."""
    shared = df.sparkSession.sparkContext.broadcast(automaton)
    at = len(kept)
    place = kept.index(text_col) if max_coverage is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value.scan
        for whole in batches:
            for b in common.slices(whole, 4096):
                texts = b.column(at).to_pylist()
                before = zip(b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist(), strict=True) if more else iter([(None, None)] * b.num_rows)
                rows, out = [], []
                for i, (text, (had, had_items)) in enumerate(zip(texts, before, strict=True)):
                    ws = words(text)
                    found, ids = scan(ws)
                    spans = union([*found, *zip(had[::2], had[1::2], strict=True)] if had else found)
                    if place is None:
                        out.append((len(ws), [x for s in spans for x in s], sorted(ids.union(had_items or ()))))
                    elif sum(z - a for a, z in spans) <= max_coverage * len(ws):
                        rows.append(i)
                        out.append(cut_out(text, spans) if spans else text)
                if place is None:
                    count, spans, names = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], [*kept, WORDS, SPANS, ITEMS])
                else:
                    left = b.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == place else left.column(i) for i in range(at)], kept)

    added = [] if place is not None else [T.StructField(WORDS, T.LongType()), T.StructField(SPANS, SPAN_KIND), T.StructField(ITEMS, ITEM_KIND)]
    needed = [*(F.col(f"`{n}`") for n in kept), F.col(f"`{text_col}`").alias("_dc_text"), *([SPANS, ITEMS] if more else [])]
    return df.select(*needed).mapInArrow(common.tidy(run), T.StructType([*(df.schema[n] for n in kept), *added]))


def _found(df: DataFrame, items: DataFrame, text_col: str, kept: list[str], item_id_col: str, item_text_col: str, window: int, block_bytes: int, max_coverage: float | None = None) -> DataFrame:
    blocks = _blocks(items, item_id_col, item_text_col, block_bytes)
    automaton = lambda block: ItemAutomaton(((n, words(t)) for n, t in block), window)
    first = next(blocks)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = df.withColumn(DIGEST, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")))
    parts = []
    for block in blocks:  # rare: the items are more than one block
        part = _scanned(named, automaton(block), text_col, [DIGEST])
        parts.append(common.cut(part.where(F.size(SPANS) > 0).select(DIGEST, SPANS, ITEMS).dropDuplicates([DIGEST]), "decontaminate"))
    if not parts:
        return _scanned(df, automaton(first), text_col, kept, max_coverage=max_coverage)
    more = reduce(DataFrame.unionByName, parts).groupBy(DIGEST).agg(F.flatten(F.collect_list(SPANS)).alias(SPANS), F.flatten(F.collect_list(ITEMS)).alias(ITEMS))
    more = common.cut(more, "decontaminate-more")
    for part in parts:
        common.discard(part)
    return _scanned(named.join(more, DIGEST, "left"), automaton(first), text_col, kept, True, max_coverage)


def find(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of df (all, if none are named), n_words, hit_spans (numbers of the first word and of the one after
    the last, flat) and hit_items, the ids of the items that occur."""
    out = {"n_words": WORDS, "hit_spans": SPANS, "hit_items": ITEMS}
    kept = [n for n in df.columns if n not in out and (keep is None or n in keep)]
    found = _found(df, items, text_col, kept, item_id_col, item_text_col, window, block_bytes)
    return found.select(*(F.col(f"`{n}`") for n in kept), *(F.col(c).alias(n) for n, c in out.items()))


def hit_words(spans: str | Column) -> Column:
    """How many words the spans cover."""
    c = F.col(spans) if isinstance(spans, str) else spans
    return F.aggregate(F.transform(c, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x).cast("long")


def clean(df: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10, max_coverage: float = 0.5, item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df without the hit spans, and without the rows of which more than max_coverage of the words are hit."""
    return _found(df, items, text_col, df.columns, item_id_col, item_text_col, window, block_bytes, max_coverage)


def digests(df: DataFrame, items: DataFrame, id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its words, hit words and occurring items."""
    found = find(df, items, keep=[id_col], block_bytes=block_bytes)
    n_hit = hit_words("hit_spans")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
part AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, n, item FROM part JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
