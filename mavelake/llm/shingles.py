"""Word shingles of whole texts as hashed bags, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Hashes keep so many bits, the rest of a 64-bit key numbers the text within its slice.
HASH_BITS = 52
MAX_TEXTS = 1 << (64 - HASH_BITS)

#: Bytes of text that are hashed together: the arrays take about fifty times that.
PIECE = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def forget() -> None:
    """Drop the tables that grow with the longest piece."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(texts: list[str | None], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, text after text, and the number of words of each text.

    The hash of a word is a difference of prefix sums of byte codes times powers of an odd base, shifted back to the
    word's start by the inverse power (exact modulo 2**64), then mixed. It doesn't depend on the word's place, so a long
    buffer is worked on piece by piece, cut between words.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    folded = (b" " + b" ".join(raw) + b" ").translate(FOLD)
    del raw
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(folded) - 1:  # a piece begins and ends with a space, which it shares with its neighbours
        end = len(folded) - 1
        if end - at > piece:
            end = folded.rfind(b" ", at + 1, at + piece + 1)
            end = end if end >= 0 else folded.index(b" ", at + piece)
        buffer = np.frombuffer(folded, np.uint8, end + 1 - at, at)
        inside = buffer != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        power, inverse = _powers(len(buffer))
        total = np.cumsum(_BYTE[buffer] * power[: len(buffer)])
        hashes.append(mix((total[stop - 1] - total[start - 1]) * inverse[start]))
        starts.append(start + at)
        at = end
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


def bags(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, hash and count of each distinct shingle, sorted by the first two, and a 64-bit digest of each
    text's words in order. A text of fewer words, but not none, is one shingle; one without words has none and digest 0."""
    if len(texts) > MAX_TEXTS:
        raise ValueError(f"at most {MAX_TEXTS} texts at once")
    h, n = word_hashes(texts)
    ends = np.cumsum(n)
    first = ends - n
    digest = np.zeros(len(n), np.uint64)
    if len(h):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(mix(h ^ mix(place + np.uint64(1)))))
        digest = np.where(n > 0, mix(sums[ends] - sums[first] + n.astype(np.uint64)), np.uint64(0))
    padded = np.append(h, np.zeros(width, np.uint64))
    many = np.maximum(n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        s += padded[at + k] * _SLOT[k]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        text, s = np.append(text, few), np.append(s, digest[few])
    key = (text.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(s) >> np.uint64(64 - HASH_BITS))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), counts, digest
