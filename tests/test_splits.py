"""Files read by byte ranges against the same files read from their beginning by plain Python."""

import gzip
import struct
import zlib

import numpy as np
import pytest

from mavelake.sources import splits
from mavelake.sources.fastq import read_fastq


def plain_records(text: bytes):
    """Sequence and quality of each complete record."""
    lines = text.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [(lines[i + 1].rstrip(b"\r").decode(), lines[i + 3].rstrip(b"\r").decode()) for i in range(0, len(lines) - 3, 4)]


def block_gzip(text: bytes, rng) -> bytes:
    """Members of at most 64 KB that state their size, among them empty ones, and an empty one at the end."""
    out, at, cuts = [], 0, []
    while at < len(text):
        n = int(rng.choice([0, 1, 50, 700, 3000]))
        cuts.append(text[at : at + n])
        at += n
    for piece in [*cuts, b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(piece) + c.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


def fastq(rng, n: int, end: bytes = b"\n", tail: bytes = b"") -> bytes:
    """Records of many lengths whose qualities often look like ids, and are as often '+' alone."""
    out = []
    for i in range(n):
        size = int(rng.choice([0, 1, 1, 30, 200]))
        seq = bytes(rng.choice(list(b"ACGTN"), size).astype(np.uint8))
        out += [b"@r%d" % i, seq, b"+", (b"@" + b"+" * size)[:size]]
    return end.join(out) + end + tail


@pytest.fixture(scope="module", params=["plain", "blocks"])
def files(request, tmp_path_factory):
    """Texts of three pairs of files, of which one ends within a record and one lacks its last line break, and their paths."""
    rng, folder = np.random.default_rng(5), tmp_path_factory.mktemp(request.param)
    texts, paths = [], []
    for i, (n, m) in enumerate([(300, 280), (0, 40), (500, 900)]):
        pair = [fastq(rng, n, b"\r\n" if i == 2 else b"\n", b"@cut\nAC\n" if i == 0 else b"@last\nACG\n+\nIII" if i == 2 else b""), fastq(rng, m)]
        texts.append([b"" if n == 0 else pair[0], pair[1]])
        names = [folder / f"{i}_{k}.fastq{'.gz' if request.param == 'blocks' else ''}" for k in (1, 2)]
        for name, text in zip(names, texts[-1], strict=True):
            name.write_bytes(block_gzip(text, rng) if request.param == "blocks" else text)
        paths.append([str(x) for x in names])
    return texts, paths


def rows(df):
    return sorted((r.file_idx, r.read_idx, r.seq1, r.qual1, r.seq2, r.qual2) for r in df.collect())


@pytest.mark.parametrize("split_bytes", [1500, 61_003])
def test_single(spark, files, split_bytes):
    texts, paths = files
    want = [(i, *r) for i, (t, _) in enumerate(texts) for r in plain_records(t)]
    want = [(i, k, s, q, None, None) for k, (i, s, q) in enumerate(want)]
    df = read_fastq(spark, [p for p, _ in paths], split_bytes=split_bytes)
    got = [(r.file_idx, r.read_idx, r.seq1, r.qual1, r.seq2, r.qual2) for r in df.orderBy("read_idx").collect()]
    assert got == want
    if split_bytes == 1500:
        assert df.rdd.getNumPartitions() > 3
    some = read_fastq(spark, [p for p, _ in paths], max_n_reads=333, split_bytes=split_bytes)
    assert [r.read_idx for r in some.orderBy("read_idx").collect()] == list(range(333))


def test_pairs(spark, files):
    texts, paths = files
    want = [(i, a, b) for i, (t, u) in enumerate(texts) for a, b in zip(plain_records(t), plain_records(u), strict=False)]
    want = [(i, k, *a, *b) for k, (i, a, b) in enumerate(want)]
    assert rows(read_fastq(spark, *map(list, zip(*paths, strict=True)), split_bytes=5000)) == want
    assert rows(read_fastq(spark, *map(list, zip(*paths, strict=True)), max_n_reads=299, split_bytes=5000)) == want[:299]


def test_every_cut(tmp_path):
    """All ways to cut a small file, ranges of one byte included."""
    rng = np.random.default_rng(9)
    for end, tail in ((b"\n", b""), (b"\r\n", b"@x\nA\n+\nI"), (b"\n", b"@x\nA\n+\n")):
        text = fastq(rng, 6, end, tail)
        p = tmp_path / "x.fastq"
        p.write_bytes(text)
        for size in (1, 2, 3, 5, 17, 100, len(text) - 1):
            ranges = splits.Ranges.of([str(p)], [], size)
            pieces = [b"".join(splits.texts(str(p), splits.PLAIN, int(a), int(b), [])) for a, b in zip(ranges.start, ranges.end, strict=True)]
            assert b"".join(pieces) == text
            breaks, inside = np.array([x.count(b"\n") for x in pieces]), np.array([int(not x.endswith(b"\n")) if x else -1 for x in pieces])
            got = []
            for _, number, n, at, skip, *_ in splits.tasks(ranges, breaks, inside, 1, -1).tolist():
                lines = list(splits.lines_from(str(p), splits.PLAIN, int(ranges.start[at]), skip))
                assert number == len(got)
                got += plain_records("".join(lines).encode())[:n]
            assert got == plain_records(text)


def test_unsplittable(spark, tmp_path):
    """Ordinary gzip is one range, and so is a pair with such a file; a damaged member is an error."""
    rng = np.random.default_rng(2)
    text = fastq(rng, 200)
    (tmp_path / "a.fastq").write_bytes(text)
    with gzip.open(tmp_path / "a.fastq.gz", "wb") as f:
        f.write(text)
    assert splits.kind_of(str(tmp_path / "a.fastq.gz")) == splits.WHOLE
    a, g = str(tmp_path / "a.fastq"), str(tmp_path / "a.fastq.gz")
    want = [(0, k, *r, *r) for k, r in enumerate(plain_records(text))]
    assert read_fastq(spark, a, g, split_bytes=500).rdd.getNumPartitions() == 1
    assert rows(read_fastq(spark, a, g, split_bytes=500)) == want
    mixed = rows(read_fastq(spark, [a, a], [g, a], split_bytes=500))
    assert mixed == want + [(1, k + len(want), *x) for _, k, *x in want]
    blocks = bytearray(block_gzip(text, rng))
    for damaged in (blocks[:-28] + b"no member of any size", blocks[:-40], blocks[:900] + bytes([blocks[900] ^ 1]) + blocks[901:]):
        (tmp_path / "d.fastq.gz").write_bytes(bytes(damaged))
        with pytest.raises(Exception, match="member|zlib|Error"):
            read_fastq(spark, str(tmp_path / "d.fastq.gz"), split_bytes=500).count()
