"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a run of frames and a footer seek table (a skippable
frame with the sizes of all frames), so any frame can be read by itself. The index maps each record id to its bundle, its
frame's offset and length in the file, and its own offset within the frame.

Of records with equal payloads of a least size, that with the largest id is the response; the others are revisits, which
hold no payload but refer to it. Equal payloads meet as digests in pre-aggregated maxima; payloads are shuffled only for a
join too large to be broadcast, whose skewed digests adaptive execution can split, as both sides are plain exchanges.

Bundles go to the shared folder (any store that Arrow's file systems reach). A task attempt writes files of its own names
and only the files of successful attempts are in the index, which Spark commits, so lost or repeated tasks do no harm.

Defined cases: a null payload counts as empty; a null id is kept and is never a response that others refer to, unless all
ids of the payload are null, which then are all responses; rows that repeat an id and a payload are all responses or all
revisits; payloads are kept whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"  # of every record: archives depend on their input alone
PREFIX = "urn:mavelake:page:"


def open_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path of a folder that is named by a URI."""
    return pafs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a stored HTTP response, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{PREFIX}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Writes records into frames of about frame_bytes, and the seek table at the end."""

    def __init__(self, stream, frame_bytes: int = 256 << 10, level: int = 3):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending: list[bytes] = []
        self.held = self.position = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """Number of the record's frame and its offset in there."""
        if self.pending and self.held + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.held)
        self.pending.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.pending:
            packed = self.packer.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.frames.append((len(packed), self.held))
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.stream.close()


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """Offset, packed and unpacked size of each frame, from the footer."""
    stream.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    stream.seek(size - 9 - n * width)
    entries, out, at = stream.read(n * width), [], 0
    for i in range(n):
        packed, unpacked = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, unpacked))
        at += packed
    return out


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an unpacked frame, from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        yield at, headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """id, url, payload, digest, kind and refers_to of each row."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = base.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    same = common.cut(same.select("digest", "response"), "equal-payloads")
    revisit = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return base.join(same, "digest", "left").select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("response")).alias("refers_to"))


INDEX = "record_id long, bundle string, frame int, frame_offset long, frame_bytes long, record_offset long"


def write(records: DataFrame, folder: str, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write the rows of roles() as bundles of about bundle_bytes of records; returns the index of all records."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    folder = common.qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        writer = path = None
        placed: list[tuple] = []
        total = 0

        def finish() -> pa.RecordBatch:
            writer.close()
            starts = [0]
            for packed, _ in writer.frames:
                starts.append(starts[-1] + packed)
            rows = [(i, path, f, starts[f], writer.frames[f][0], o) for i, f, o in placed]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

        for whole in batches:
            for b in common.slices(whole, 4096):
                for i, url, payload, digest, kind, refers_to in zip(*(b.column(n).to_pylist() for n in ("id", "url", "payload", "digest", "kind", "refers_to")), strict=True):
                    if writer is None:
                        path, placed, total = f"{base}/{uuid.uuid4().hex}.warc.zst", [], 0
                        fs.create_dir(base, recursive=True)
                        writer = BundleWriter(fs.open_output_stream(path, compression=None))
                    data = record(i, url, payload, digest, kind, refers_to)
                    placed.append((i, *writer.add(data)))
                    total += len(data)
                    if total >= bundle_bytes:
                        yield finish()
                        writer = None
        if writer is not None:
            yield finish()

    return common.cut(records.mapInArrow(run, INDEX), "warc-index")


def _page(name: str) -> int | None:
    x = name.strip("<>").removeprefix(PREFIX)
    return None if x == "null" else int(x)


ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _row(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        if hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        return _page(headers["WARC-Record-ID"]), len(payload), stated, "response", None, payload
    size = int(head.rpartition(b"Content-Length: ")[2])
    return _page(headers["WARC-Record-ID"]), size, stated, "revisit", _page(headers["WARC-Refers-To"]), None


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in ROW.split(", ")]
    n = len(names) if payloads else len(names) - 1
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names[:n])


def read(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the bundles that the index names, frame after frame; payloads (null for revisits) on demand."""

    folder = common.qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            for path, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data = unpacker.decompress(f.read(size))
                yield _batch([_row(h, block) for _, h, block in parse(data)], payloads)

    frames = index.select("bundle", "frame_offset", "frame_bytes").distinct()
    return frames.mapInArrow(run, ROW if payloads else ROW.rpartition(",")[0])


def fetch(index: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """The records of some ids (a column `record_id`), each by a seek to its frame and its offset in there."""

    folder = common.qualified(index.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            for path, start, size, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data = unpacker.decompress(f.read(size))
                yield _batch([_row(h, block) for _, h, block in [next(parse(data, at))]], True)

    wanted = index.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    return wanted.select("bundle", "frame_offset", "frame_bytes", "record_offset").mapInArrow(run, ROW)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all pages; returns the index and the folder."""
    folder = common.qualified(spark, folder or common.scratch_path(spark, "warc"))
    return write(roles(pages), folder), folder


def digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    index, folder = archive(spark, pages)
    return read(index, folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS response FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> response THEN response END AS refers_to
FROM r
"""
