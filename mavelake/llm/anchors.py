"""Content-defined anchors of byte windows, computed for many texts at once.

Every window of SPAN bytes is assigned to the least hash among the GRAM-byte strings inside it, the leftmost of equals: its
anchor. Equal windows have equal anchors at equal offsets, wherever they stand, so windows that match can be found by
meeting at their anchor's hash. Consecutive windows share anchors: a text has about 2 / (SPAN - GRAM + 2) of its bytes as
anchors. Long grams make it rare that different windows share one.

Texts of more than PIECE bytes are worked on in overlapping pieces, so memory is bounded whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix

SPAN, GRAM = 100, 48
WINDOW = SPAN - GRAM + 1  # gram starts in a window
#: Bytes of text that are hashed together, so few that the arrays, about sixty times that, hardly leave a core's cache.
PIECE = 1 << 18
#: Hashes are compared without their last bits, which number the places in the buffer: the same at every size.
PLACE_BITS = 23

_rng = np.random.default_rng(20240815)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def forget() -> None:
    _POWERS.clear()


def grams(buffer: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on: a difference of prefix sums, shifted back by the inverse power."""
    n = len(buffer) + 1 - GRAM
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(buffer) + 1)
    sums = np.append(np.uint64(0), np.cumsum(_CODE[buffer] * power[: len(buffer)]))
    return mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n])


def pieces(texts: list[str | None], piece: int = PIECE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of pieces of bounded size: number of the text, place in its bytes, and bytes. Pieces of one text overlap, so that
    every window is in exactly one of them."""
    rows: list[int] = []
    places: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - SPAN + 1), piece):
            part = raw[at : at + piece + SPAN - 1]
            if parts and size + len(part) > piece + SPAN:
                yield rows, places, parts
                rows, places, parts, size = [], [], [], 0
            rows.append(i)
            places.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, places, parts


def runs(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: number of its part, the anchor's hash and place, and the first and the last
    window of the run (places in the part)."""
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    none = np.zeros(0, np.int64)
    if len(buffer) < SPAN:
        return none, np.zeros(0, np.uint64), none, none, none
    gram = grams(buffer)
    bits = np.uint64(PLACE_BITS)
    if len(gram) >> PLACE_BITS:
        raise ValueError("too many bytes at once")
    key = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)  # the leftmost of equal hashes is least
    least, reach = key, 1
    while 2 * reach <= WINDOW:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (WINDOW - reach)], least[WINDOW - reach :])
    anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(parts)), np.diff(bounds))[: len(anchor)]
    inside = np.arange(len(anchor)) + SPAN <= bounds[text + 1]
    first = inside & np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(inside & np.append(first[1:] | ~inside[1:], True))
    text = text[starts]
    return text, gram[anchor[starts]], anchor[starts] - bounds[text], starts - bounds[text], ends - bounds[text]
