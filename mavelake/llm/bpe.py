"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens that a partition has not met yet are laid out in one symbol array with links to both neighbours. An
index maps each mergeable pair to all its positions in there. Active ranks are taken in ascending order from a heap; all
positions of the rank's pair are merged from left to right, and the lists of the pairs that arise beside them are updated.
As a merge can only bring up higher ranks (the constructor makes sure), one ascending run serves all words. Ids are kept per
chunk and per word in caches of bounded bytes; that of words has two generations, so those in use stay.

Texts of more than PART characters are cut at lone spaces, where the pre-tokenizer always starts a new token, and encoded
part by part: memory is bounded by SLICE and the longest run of text without such a space.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts are taken whole,
whatever their length; repeated rows give repeated results; other columns are kept by `encode` and `decode` and may have
any name but the output's (which replaces one of that name). Ids that the vocabulary lacks are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: How the byte-level pre-tokenizer splits a text (fixed value of the public format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def printable_bytes() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for themselves, the others for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Bytes of text that are encoded together: the arrays take about fifteen times that.
SLICE = 1 << 20
#: Characters of a text from which on it is cut into parts.
PART = 1 << 19
#: Bytes of the cache of chunks, and of each generation of the cache of words, estimated.
CACHE_BYTES = 24 << 20
#: White space that doesn't stand alone as one space between other characters: such texts aren't cut into chunks.
WIDE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |^[ \n]|[ \n]$"
#: The rank of a pair that doesn't merge.
NONE = np.iinfo(np.int64).max
LONE = regex.compile(r"(?<=\S) (?=\S)")


def parts(text: str, most: int = PART) -> Iterator[str]:
    """Parts of a text that can be encoded by themselves."""
    at = 0
    while len(text) - at > most:
        m = LONE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class ByteBpe:
    """Encoder and decoder for one tokenizer.json of the byte-level BPE kind."""

    def __init__(self, spec: bytes, cache_bytes: int = CACHE_BYTES):
        conf = json.loads(spec)
        model, pre = conf["model"], conf["pre_tokenizer"]
        if (
            model["type"] != "BPE"
            or pre["type"] != "ByteLevel"
            or pre["add_prefix_space"]
            or conf["normalizer"]
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            or any(t[k] for t in conf["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        ):
            raise ValueError("only plain byte-level BPE files are supported")
        alphabet = printable_bytes()
        vocab = model["vocab"]
        bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in conf["added_tokens"]}
        bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.size = size = max(bytes_of) + 1
        of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.of_byte = np.array(of_byte, np.int32)
        self.shift = size.bit_length()
        self.rank: dict[int, int] = {}
        # what a token merges with on its right and on its left, and the ranks: small tables that stay in a core's cache
        self.with_right: dict[int, dict[int, int]] = {}
        self.with_left: dict[int, dict[int, int]] = {}
        left_of, right_of, made = [], [], []
        born = set(of_byte)
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            if left not in born or right not in born:
                raise ValueError("a merge uses a token that only a later merge makes")
            born.add(new)
            self.rank[left << self.shift | right] = r
            self.with_right.setdefault(left, {})[right] = r
            self.with_left.setdefault(right, {})[left] = r
            left_of.append(left)
            right_of.append(right)
            made.append(new)
        self.left_of, self.right_of, self.made = (array("i", x) for x in (left_of, right_of, made))
        self.keys, self.key_rank = (np.array(x, np.int64) for x in zip(*sorted(self.rank.items()), strict=True))
        self.split = regex.compile(SPLIT).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.token_bytes, self.token_text = pa.array([bytes_of.get(i, b"") for i in range(size)], pa.binary()), pa.array(map(str, range(size)), pa.string())
        self.cache_bytes = cache_bytes
        self.words: dict[str, bytes] = {}  # word -> its ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.words_held = 0
        self.forget()

    def forget(self) -> None:
        """Empty the cache of chunks: chunk -> its number; the ids of a chunk are ids[start : start + count]."""
        self.cache: dict[str, int] = {}
        self.held = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they don't merge or a word ends between them."""
        keys = left.astype(np.int64) << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_rank[at], NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens (32-bit numbers), all merged together by a pair occurrence index."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        first = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(first)
        if not n:
            return [b"" for _ in words]
        word = np.repeat(np.arange(len(raw)), sizes)
        last = np.append(word[1:] != word[:-1], True)
        follows = np.where(last, -1, np.arange(1, n + 1))
        rank = self.ranks(first, np.where(last, -1, np.append(first[1:], -1)))
        # the index: rank of a pair -> the positions of its first symbols
        at = np.flatnonzero(rank != NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        new = np.flatnonzero(np.append(True, np.diff(rank[at]) != 0)) if len(at) else at
        heap = rank[at[new]].tolist()
        places, edges = at.tolist(), [*new.tolist(), len(at)]
        index = {r: places[a:z] for r, a, z in zip(heap, edges, edges[1:], strict=False)}
        symbol, nxt = first.tolist(), follows.tolist()
        prv = np.where(np.append(True, last[:-1]), -1, np.arange(-1, n - 1)).tolist()
        none: dict[int, int] = {}
        while heap:
            r = heapq.heappop(heap)
            left, right, made = self.left_of[r], self.right_of[r], self.made[r]
            rank_right, rank_left = self.with_right.get(made, none), self.with_left.get(made, none)
            for p in sorted(index.pop(r)):  # overlapping occurrences merge from the left
                q = nxt[p]
                if symbol[p] != left or q < 0 or symbol[q] != right:
                    continue  # a merge beside it took one of the two
                symbol[p], symbol[q] = made, -1
                nxt[p] = q = nxt[q]
                if q >= 0:
                    prv[q] = p
                    x = symbol[q]
                    if x in rank_right:
                        x = rank_right[x]
                        if x in index:
                            index[x].append(p)
                        else:
                            index[x] = [p]
                            heapq.heappush(heap, x)
                o = prv[p]
                if o >= 0:
                    x = symbol[o]
                    if x in rank_left:
                        x = rank_left[x]
                        if x in index:
                            index[x].append(o)
                        else:
                            index[x] = [o]
                            heapq.heappush(heap, x)
        left = np.array(symbol, np.int32)
        alive = left >= 0
        ends = (4 * np.append(0, np.cumsum(alive))[np.append(0, np.cumsum(sizes))]).tolist()
        flat = left[alive].tobytes()
        return [flat[a:z] for a, z in zip(ends, ends[1:], strict=False)]

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, of which those in no cache are merged now."""
        if self.words_held > self.cache_bytes:
            self.words, self.older, self.words_held = {}, self.words, 0
        out = list(map(self.words.get, words))
        at = [i for i, ids in enumerate(out) if ids is None]
        lacking = [words[i] for i in at]
        ids = list(map(self.older.get, lacking))
        new = [w for w, x in zip(lacking, ids, strict=True) if x is None]
        merged = iter(self.merge(new))
        ids = [next(merged) if x is None else x for x in ids]
        for i, x in zip(at, ids, strict=True):
            out[i] = x
        self.words.update(zip(lacking, ids, strict=True))
        self.words_held += sum(map(len, lacking)) + sum(map(len, ids)) + 180 * len(ids)
        return out

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens; a string of a special token is a piece of its own."""
        if self.specials is None or not any(s in text for s in self.added):
            return self.split(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.added:
                out.append(part)
            elif part:
                out.extend(self.split(part))
        return out

    def numbers(self, chunks: list[str], spaced: bool = False) -> np.ndarray:
        """The cache's numbers of chunks, of which the unknown ones are encoded now; spaced: each is a lone space and what
        follows it up to the next one, so they can be split as one text."""
        cache = self.cache
        new = [c for c in dict.fromkeys(chunks) if c not in cache]
        if new:
            if spaced:
                tokens = self.split("".join(new))
            else:
                split = [[c] if c in self.added else self.split(c) for c in new]
                tokens = [w for ws in split for w in ws]
            coded = pa.array(tokens, pa.string()).dictionary_encode()
            words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            special = [i for i, w in enumerate(words) if w in self.added] if self.added and not spaced else []
            known = self.known(words if not special else [w for w in words if w not in self.added])
            for i in special:  # in ascending order
                known.insert(i, np.int32(self.added[words[i]]).tobytes())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            per_token = sizes[at]
            ends = np.cumsum(per_token)
            total = int(ends[-1]) if len(ends) else 0
            flat = np.frombuffer(b"".join(known), np.int32)
            flat = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - per_token), per_token) + np.arange(total)]
            if spaced:
                begin = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words))[at])
                edges = np.append(0, ends)[np.append(begin, len(at))]
            else:
                edges = np.append(0, ends)[np.cumsum([0, *map(len, split)])]
            first, end = len(cache), self.used + total
            if end > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(end, np.int32))
            if first + len(new) > len(self.start):
                more = np.zeros(first + len(new), np.int64)
                self.start, self.count = np.append(self.start, more), np.append(self.count, more)
            self.ids[self.used : end] = flat
            self.count[first : first + len(new)] = np.diff(edges)
            self.start[first : first + len(new)] = self.used + edges[:-1]
            self.used = end
            cache.update(zip(new, range(first, first + len(new)), strict=True))
            # a string with its dictionary entry and number, and its ids and bounds
            self.held += sum(map(len, new)) + 180 * len(new) + 4 * total
        return np.fromiter(map(cache.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has.

        Wherever a lone space stands between two other characters that aren't white space, the pre-tokenizer starts a new
        token at the space, so a text can be cut there and each distinct chunk be encoded once.
        """
        if self.held > self.cache_bytes:
            self.forget()
        as_py = texts.to_pylist()
        odd = pc.match_substring_regex(texts, WIDE)
        for s in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        cut = texts
        if whole:
            keep = np.ones(len(as_py), bool)
            keep[whole] = False
            cut = pc.if_else(pa.array(keep), texts, "")
        lists = pc.split_pattern(cut, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        empty = distinct.index("") if "" in distinct else -1  # stands first in a text only, where it is replaced below
        if empty >= 0:
            del distinct[empty]
        found = self.numbers([f" {c}" for c in distinct], spaced=True)
        number = (found if empty < 0 else np.insert(found, empty, 0))[coded.indices.to_numpy()]
        out = set(whole)
        number[offsets[:-1] - offsets[0]] = self.numbers(["" if i in out else t.partition(" ")[0] for i, t in enumerate(as_py)])
        number = np.split(number, offsets[1:-1] - offsets[0]) if whole else [number]
        sizes = np.diff(offsets)
        for i in whole:
            number[i] = self.numbers(self.pieces(as_py[i]))
            sizes[i] = len(number[i])
        at = np.concatenate(number)
        counts = self.count[at]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        per_text = np.diff(np.concatenate([[0], np.append(0, ends)[np.cumsum(sizes)]]))
        return ids, per_text

    def lists(self, values: pa.Array, per_text: np.ndarray) -> pa.ListArray:
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text)), pa.int64()), values)

    def raw(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        known = self.token_bytes.take(pa.array(ids, pa.int64()))
        return pc.binary_join(self.lists(known, per_text), b"").to_pylist()

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        """The texts of ids; bytes that aren't UTF-8 become replacement characters."""
        return [x.decode("utf-8", "replace") for x in self.raw(ids, per_text)]

    def joined(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        return pc.binary_join(self.lists(self.token_text.take(pa.array(ids, pa.int64())), per_text), ",").to_pylist()


_ENGINES: dict[int, ByteBpe] = {}


def _engine(spec: bytes) -> ByteBpe:
    key = hash(spec)
    if key not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[key] = ByteBpe(spec)
    return _ENGINES[key]


def _shared_model(df: DataFrame, model_path: str):
    """The model file (a fixed size of one or two MB), read on the driver and broadcast."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def _plus(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _encoded(bpe: ByteBpe, texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Ids of texts in groups of bounded size: the rows of the group's parts (a long text has several, in order, and may go
    on in the next group), the ids and how many each part has."""
    group: list[str] = []
    rows: list[int] = []
    size = 0
    for row in range(len(texts)):
        for part in parts(texts[row].as_py() or ""):
            group.append(part)
            rows.append(row)
            size += len(part)
            if size >= SLICE:
                yield rows, *bpe.encode(pa.array(group, pa.string()))
                group, rows, size = [], [], 0
    if group:
        yield rows, *bpe.encode(pa.array(group, pa.string()))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", rows: int = 2048) -> DataFrame:
    """df with a column of token ids."""
    model = _shared_model(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _engine(model.value)
        for whole in batches:
            for b in common.slices(whole, rows, SLICE):
                per_row, ids = np.zeros(b.num_rows, np.int64), []
                for at, found, counts in _encoded(bpe, b.column(text_col)):
                    np.add.at(per_row, at, counts)
                    ids.append(found)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield _with(b, out_col, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()), pa.array(flat, pa.int32())))

    return df.mapInArrow(common.tidy(run), _plus(df, out_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded", rows: int = 2048) -> DataFrame:
    """df with the text of a column of token ids; null ids give an empty text."""
    model = _shared_model(df, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _engine(model.value)
        for whole in batches:
            for b in common.slices(whole, rows, SLICE):
                lists = pc.fill_null(b.column(ids_col), [])
                counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                if len(ids) and not (0 <= ids.min() and ids.max() < bpe.size):
                    raise ValueError("an id that the vocabulary lacks")
                yield _with(b, out_col, pa.array(bpe.decode(ids, counts), pa.string()))

    return df.mapInArrow(common.tidy(run), _plus(df, out_col, T.StringType()))


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 2048) -> DataFrame:
    """Encode and decode in one pass and return the digests of both: no token list leaves the Python worker."""
    model = _shared_model(df, model_path)
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _engine(model.value)
        for whole in batches:
            for b in common.slices(whole, rows, SLICE):
                n = [0] * b.num_rows
                of_ids, of_text = ([hashlib.sha256() for _ in n] for _ in range(2))
                for at, ids, counts in _encoded(bpe, b.column(1)):
                    # a part ends where a token ends, which is between characters, so its bytes are whole UTF-8
                    for row, k, joined, raw in zip(at, counts.tolist(), bpe.joined(ids, counts), bpe.raw(ids, counts), strict=True):
                        of_ids[row].update((("," if n[row] and k else "") + joined).encode())
                        of_text[row].update(raw.decode("utf-8", "replace").encode())
                        n[row] += k
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array([x.hexdigest() for x in d]) for d in (of_ids, of_text))], schema.names)

    return df.select(id_col, text_col).mapInArrow(common.tidy(run), schema)
