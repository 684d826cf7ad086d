"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked.

The cumulative ends of both token sequences are merged: where both end, a group ends; each interval between two merged ends
lies in one token of either side, which makes it their link. That is a map over the documents; Spark then counts in how many
documents each pair of ids is linked, takes the highest count of each id on either side, and joins both back to the links.

Texts are cut into chunks where neither tokenizer can join what stands on the two sides: at lone spaces and, in long runs
without any, where the first has a pre-token boundary and the second has no piece with these two characters in a row. So a
chunk's tokens, groups and links don't depend on its neighbours, equal chunks are tokenized once per task, and texts of any
length are worked on in pieces. Only a run in which no such place exists (one letter or space repeated) is tokenized as a whole.

Counting: the most frequent pairs, at most HOT_PAIRS of them, are broadcast (a bound on rows, whatever the corpus); all other
pairs are joined by a shuffle in which no key is frequent, as the frequent ones were taken out. Per-id maxima have a row per
vocabulary entry at most.

Defined cases: null and empty texts, and texts whose joined token bytes differ from a space and the text (U+2581, which the
second tokenizer reads as a space), have no tokens: zeros and an empty string. Repeated rows and ids are rows of their own,
each counted as a document. Strings of special tokens are plain text. Other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import SPLIT, printable_bytes

#: Characters of text in one piece of work, and of a chunk from which on places inside of words are looked for.
PIECE, LONG = 1 << 20, 1 << 15
#: Estimated bytes of the chunks that a task remembers.
CACHE_BYTES = 128 << 20
#: Pairs of ids whose counts are broadcast.
HOT_PAIRS = 1 << 19
#: Characters that may be white space or invisible to some library: spaces next to them aren't places to cut.
EDGE = r"\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\u2581\ufeff"
LONE = re.compile(f"(?<=[^{EDGE}]) (?=[^{EDGE}])")
SPACE = re.compile(f"[{EDGE}]")
MARK = "\u2581"


def _flat(strings: pa.Array) -> bytes:
    """The bytes of a new array of strings, one after the other."""
    if not len(strings):
        return b""
    end = np.frombuffer(strings.buffers()[1], np.int32)[len(strings)]
    return strings.buffers()[2].to_pybytes()[:end]


class Aligner:
    """Both tokenizers, what they have made of the chunks met so far, and the groups and links of these."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = printable_bytes()
        of_a = {i: bytes(alphabet[c] for c in t) if alphabet.keys() >= set(t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(regex.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces):
            raise ValueError("a piece of the second tokenizer reaches over a space or a line break")
        self.size_a, self.size_b = max(of_a) + 1, len(pieces)
        bytes_a = [of_a.get(i, b"") for i in range(self.size_a)]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        self.together = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # an id with what follows it: A's ids, A's last of a group, B's ids, B's last of a group
        self.written = pa.array([f"{i}{s}" for n, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for s in marks for i in range(n)], pa.string())
        self.split = regex.compile(SPLIT)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []  # of each chunk; each group ends in a semicolon
        self.counts = array("q")  # per chunk: tokens of A, of B, groups, links, place of the first link, 1 if its bytes don't agree
        self.links = array("q")
        self.held = 0

    def chunks(self, text: str) -> Iterator[list[str]]:
        """A space and the text in chunks, in lists of about PIECE characters."""
        s, at = " " + text, 0
        while at < len(s):
            m = LONE.search(s, at + PIECE) if len(s) - at > PIECE else None
            end = m.start() if m else len(s)
            first, *rest = LONE.split(s[at:end])
            out = [first, *(" " + w for w in rest)]
            if max(map(len, out)) > LONG:
                for w in out:
                    for part in self.inside(w):
                        yield part
            else:
                yield out
            at = end

    def inside(self, word: str) -> Iterator[list[str]]:
        """Parts of a long run without lone spaces."""
        at = 0
        if len(word) > LONG:
            for m in self.split.finditer(word):
                end = m.end()
                # white space isn't cut from what follows, as it may be split otherwise at the end of a text
                if LONG <= end - at and end < len(word) and not SPACE.match(word, end - 1) and word[end - 1 : end + 1].replace(" ", MARK) not in self.together:
                    yield [word[at:end]]
                    at = end
        yield [word[at:]]

    def learn(self, new: list[str]) -> None:
        """Tokenize chunks and merge their tokens' ends."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        # B puts a space first; where a chunk has none, a line break, which joins nothing, keeps the two apart
        spaced = [len(s) > 1 and s[0] == " " for s in new]
        ids_b = self.b.encode([s[1:] if ok else "\n" + s for s, ok in zip(new, spaced, strict=True)], out_type=int, num_threads=1)
        ids_b = [i if ok else i[2:] for i, ok in zip(ids_b, spaced, strict=True)]
        raw = [s.encode() for s in new]
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        bad = self.differing(raw, (self.bytes_a, self.length_a, a, n_a), (self.bytes_b, self.length_b, b, n_b))
        if bad.any():
            a, b = (x[~np.repeat(bad, n)] for x, n in ((a, n_a), (b, n_b)))
            n_a, n_b = (np.where(bad, 0, n) for n in (n_a, n_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        merged, common_ends = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        link_a, link_b = np.searchsorted(ends_a, merged), np.searchsorted(ends_b, merged)
        chunk_a = np.repeat(np.arange(len(new)), n_a)
        n_links = np.bincount(chunk_a[link_a], minlength=len(new))
        n_groups = np.bincount(chunk_a[np.searchsorted(ends_a, common_ends)], minlength=len(new))
        first = len(self.links) + np.cumsum(n_links) - n_links
        self.links.frombytes((a[link_a] * self.size_b + b[link_b]).tobytes())
        self.counts.frombytes(np.column_stack([n_a, n_b, n_groups, n_links, first, bad]).astype(np.int64).tobytes())
        self.groups += self.spelled(a, b, ends_a, ends_b, common_ends, n_a + n_b)
        start = len(self.number)
        self.number.update(zip(new, range(start, start + len(new)), strict=True))
        self.held += sum(map(len, raw)) + 8 * len(merged) + 12 * (len(a) + len(b)) + 300 * len(new)

    def differing(self, raw: list[bytes], *sides: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """For each chunk whether its tokens' bytes aren't the chunk's; a side: bytes and lengths of ids, ids, and their number."""
        sizes, whole = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        bad = np.zeros(len(raw), bool)
        for bytes_of, length, ids, n in sides:
            ends = np.append(0, np.cumsum(length[ids]))
            cuts = np.append(0, np.cumsum(n))
            wrong = np.diff(ends[cuts]) != sizes
            joined = _flat(bytes_of.take(pa.array(ids)))
            if joined != whole:  # chunk by chunk, only where there is something wrong
                at = ends[cuts].tolist()
                wrong |= np.array([joined[x:y] != r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)], bool)
            bad |= wrong
        return bad

    def spelled(self, a, b, ends_a, ends_b, common_ends, tokens) -> list[bytes]:
        """The groups of each chunk in writing: `a1,a2|b1;a3|b2,b3;`."""
        group_a, group_b = np.searchsorted(common_ends, ends_a), np.searchsorted(common_ends, ends_b)
        last_a, last_b = common_ends[group_a] == ends_a, common_ends[group_b] == ends_b
        what = np.concatenate([a + self.size_a * last_a, 2 * self.size_a + b + self.size_b * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        text = self.written.take(pa.array(what[order], pa.int32()))
        at = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1] if len(text) else np.zeros(1, np.int32)
        buffer = _flat(text)
        cuts = at[np.append(0, np.cumsum(tokens))].tolist()
        return [buffer[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Of chunks that are known: summed counts, links with repeats, how many each stands for, and groups."""
        number = self.number
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        distinct, times = np.unique(at, return_counts=True)
        table = np.frombuffer(self.counts, np.int64).reshape(-1, 6)[distinct]
        n = table[:, 3]
        places = np.arange(n.sum()) + np.repeat(table[:, 4] - np.cumsum(n) + n, n)
        links = np.frombuffer(self.links, np.int64)[places] if len(self.links) else np.zeros(0, np.int64)
        sums = times @ table[:, [0, 1, 2, 3, 5]]
        groups = self.groups
        return sums, links, np.repeat(times, n), b"".join(map(groups.__getitem__, at.tolist()))


class _Document:
    """What has been found of one document so far."""

    def __init__(self, keep_groups: bool):
        self.sums, self.sha, self.links, self.times = np.zeros(5, np.int64), hashlib.sha256(), [], []
        self.text: list[bytes] | None = [] if keep_groups else None
        self.open = False

    def add(self, sums, links, times, groups: bytes) -> None:
        self.sums += sums
        distinct, at = np.unique(links, return_inverse=True)
        self.links.append(distinct)
        self.times.append(np.bincount(at, times, len(distinct)).astype(np.int64))
        if groups:
            groups = b";" * self.open + groups[:-1]
            self.open = True
            self.sha.update(groups)
            if self.text is not None:
                self.text.append(groups)

    def row(self) -> list:
        if self.sums[4] or not self.open:
            return [0, 0, 0, 0, "", "", [], []]
        links, at = np.unique(np.concatenate(self.links), return_inverse=True)
        times = np.bincount(at, np.concatenate(self.times), len(links)).astype(np.int64)
        text = b"".join(self.text).decode() if self.text is not None else ""
        return [*self.sums[:4].tolist(), self.sha.hexdigest(), text, links, times]


_ENGINES: dict[int, Aligner] = {}


def _engine(a: bytes, b: bytes) -> Aligner:
    """One aligner per worker and pair of models: building one takes about a second."""
    key = hash((a, b))
    if key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[key] = Aligner(a, b)
    return _ENGINES[key]


def _aligned(aligner: Aligner, texts: list[str | None], keep_groups: bool) -> list[list]:
    """A row for each text. Pieces of texts are learned and read together, about PIECE characters at a time."""
    docs = [_Document(keep_groups) for _ in texts]
    waiting: list[tuple[_Document, list[str]]] = []

    def settle() -> None:
        if aligner.held > CACHE_BYTES:
            aligner.forget()
        new = list(dict.fromkeys(w for _, words in waiting for w in words if w not in aligner.number))
        if new:
            aligner.learn(new)
        for doc, words in waiting:
            doc.add(*aligner.read(words))
        waiting.clear()

    size = 0
    for doc, text in zip(docs, texts, strict=True):
        for words in aligner.chunks(text) if text else ():
            waiting.append((doc, words))
            size += sum(map(len, words))
            if size >= PIECE:
                settle()
                size = 0
    settle()
    return [d.row() for d in docs]


@dataclass
class Alignment:
    """documents: a row per document: _row, its id, n_a, n_b, n_groups, n_links, groups_sha256, groups (the text, if asked for),
    and its distinct links as pairs (a * size_b + b) with how often each occurs. pairs: a, b, n_docs, and whether no other
    pair of that a (best_a), or of that b (best_b), is in more documents."""

    documents: DataFrame
    pairs: DataFrame
    size_b: int
    scratch: common.Scratch


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False, rows: int = 512) -> Alignment:
    """Groups and links of the tokens of A (a byte-level BPE file) and B (a piece model with byte fallback)."""
    spark = df.sparkSession
    models = []
    for p in (a_path, b_path):
        with open(p, "rb") as f:
            models.append(f.read())
    sizes = Aligner(*models)
    size_a, size_b = sizes.size_a, sizes.size_b
    shared = spark.sparkContext.broadcast(models)  # two vocabulary files
    key = T.IntegerType() if size_a * size_b < 1 << 31 else T.LongType()
    names = ["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"]
    kinds = [T.LongType(), df.schema[id_col].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType(), T.ArrayType(key), T.ArrayType(T.IntegerType())]
    whole, part = np.int32 if key == T.IntegerType() else np.int64, np.int32

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _engine(*shared.value)
        for frame in frames:
            for at in range(0, len(frame), rows):
                some = frame.iloc[at : at + rows]
                found = _aligned(aligner, [t if isinstance(t, str) else None for t in some["_text"]], keep_groups)
                out = pd.DataFrame(found, columns=names[2:])
                out["pairs"] = [np.asarray(x, whole) for x in out["pairs"]]
                out["times"] = [np.asarray(x, part) for x in out["times"]]
                out.insert(0, "_id", some["_id"].to_numpy())
                out.insert(0, "_row", some["_row"].to_numpy())
                yield out

    def forget() -> None:
        for x in _ENGINES.values():
            x.forget()

    scratch = common.Scratch()
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    documents = scratch.cut(source.mapInPandas(common.tidy(run, forget), schema), "align")
    counted = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counted = scratch.cut(counted.select("pair", F.expr(f"cast(pair div {size_b} AS int)").alias("a"), F.expr(f"cast(pair % {size_b} AS int)").alias("b"), "n_docs"), "align-pairs")
    for side in "ab":  # a row per vocabulary entry at most
        highest = counted.groupBy(side).agg(F.max("n_docs").alias(f"most_{side}"))
        counted = counted.join(F.broadcast(highest), side)
    pairs = counted.select("pair", "a", "b", "n_docs", *((F.col("n_docs") == F.col(f"most_{s}")).alias(f"best_{s}") for s in "ab"))
    return Alignment(documents, scratch.cut(pairs, "align-best"), size_b, scratch)


def _least_hot(pairs: DataFrame, most: int) -> int:
    """A power of two such that at most so many pairs are in that many documents or more."""
    sizes = pairs.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    total, level = 0, 64
    for r in sorted(sizes, key=lambda r: -r.level):
        total += r.n
        if total > most:
            break
        level = r.level
    return 1 << level if level < 64 else (1 << 63) - 1


def link_sums(found: Alignment, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document (_row): n_best and n_best_b, the links whose count is the highest of their A (B) id, and count_sum over its links."""
    pairs = found.pairs.select("pair", "n_docs", "best_a", "best_b")
    least = _least_hot(pairs, hot_pairs)
    links = found.documents.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = F.broadcast(pairs.where(F.col("n_docs") >= least))
    parts = [links.join(hot, "pair")]
    rest = pairs.where(F.col("n_docs") < least)
    if not rest.isEmpty():
        parts.append(links.join(hot.select("pair"), "pair", "left_anti").join(rest.hint("merge"), "pair"))
    times = F.col("times").cast("long")
    sums = [F.sum(F.when(F.col("best_a"), times).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), times).otherwise(0)).alias("n_best_b"), F.sum(times * F.col("n_docs")).alias("count_sum")]
    again = [F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")]
    each = [p.groupBy("_row").agg(*sums) for p in parts]
    return each[0] if len(each) == 1 else each[0].union(each[1]).groupBy("_row").agg(*again)


def digests(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """A row per document: its counts, the digest of its groups, and what its links' counts come to."""
    found = align(df, a_path, b_path, id_col, text_col)
    own = ["n_a", "n_b", "n_groups", "n_links"]
    sums = found.documents.join(link_sums(found, hot_pairs), "_row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum", "n_best_b")]
    out = sums.select(F.col("_id").alias(id_col), *own, *zero, "groups_sha256")
    done = common.cut(out, "align-result")
    found.scratch.clear()
    return done
