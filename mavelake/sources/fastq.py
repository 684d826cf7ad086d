"""FASTQ files as a Spark data source, and filtered reads as FASTQ output.

Mates are read in lock step, without a join, and stop at the shorter one. A record cut off by the end of a file is dropped; a
missing final line break is accepted. Read ids and the `+` line aren't kept. Plain files and block gzip of more than
`split_bytes` are read by many tasks (`splits`). Other gzip files can't be split, so each file (pair) is one input partition;
with `maxNReads`, a single one stops early; over several, the first reads in file order are picked by a running number.
"""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import scratch
from . import splits

READS = "file_idx int, read_idx long, seq1 string, qual1 string, seq2 string, qual2 string"
BATCH = 20_000


def _open(path: str):
    if "://" in path:
        from pyarrow import fs as pafs

        system, name = pafs.FileSystem.from_uri(path)
        raw = system.open_input_stream(name, compression=None)
        return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, encoding="ascii", newline="\n")
    if path.endswith(".gz"):
        return gzip.open(path, "rt", encoding="ascii", newline="\n")
    return open(path, encoding="ascii", newline="\n")


def records(path: str, max_read_length: int) -> Iterator[tuple[str, str]]:
    """Sequence and quality of each complete record."""
    with _open(path) as lines:
        yield from records_of(lines, path, max_read_length)


def records_of(lines: Iterator[str], path: str, max_read_length: int) -> Iterator[tuple[str, str]]:
    """Sequence and quality of each complete record of lines that begin with one."""
    while True:
        four = list(itertools.islice(lines, 4))
        if len(four) < 4:
            return
        seq, qual = four[1].rstrip("\r\n"), four[3].rstrip("\r\n")
        if max(len(seq), len(qual)) > max_read_length:
            raise ValueError(f"a read of {path} is longer than maxReadLength, {max_read_length}")
        yield seq, qual


class FilePair(InputPartition):
    def __init__(self, idx: int, first: str, second: str | None):
        self.idx, self.first, self.second = idx, first, second


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.first = options["forward"].split("\n")
        self.second = options["reverse"].split("\n") if options.get("reverse") else []
        self.longest = int(options.get("maxreadlength", 1024))
        self.most = int(options.get("maxnreads", -1))

    def partitions(self) -> list[InputPartition]:
        return [FilePair(i, f, r) for i, (f, r) in enumerate(itertools.zip_longest(self.first, self.second))]

    def read(self, partition: FilePair) -> Iterator[pa.RecordBatch]:
        one = records(partition.first, self.longest)
        two = records(partition.second, self.longest) if partition.second else itertools.repeat((None, None))
        rows = ((s1, q1, s2, q2) for (s1, q1), (s2, q2) in zip(one, two))  # noqa: B905
        if self.most >= 0:
            rows = itertools.islice(rows, self.most)
        at = 0
        while chunk := list(itertools.islice(rows, BATCH)):
            columns = [*zip(*chunk, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([partition.idx] * len(chunk), pa.int32()), pa.array(range(at, at + len(chunk)), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], ["file_idx", "read_idx", "seq1", "qual1", "seq2", "qual2"])
            at += len(chunk)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, forward: list[str] | str, reverse: list[str] | str | None = None, max_n_reads: int = -1, max_read_length: int = 1024, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """The reads of one sample; several files (pairs) count as one after the other. Where a file is split, its line breaks are
    counted at once, by a job of its own."""
    names = [[x] if isinstance(x, str) else list(x or []) for x in (forward, reverse)]
    ranges = splits.Ranges.of(*names, split_bytes)
    if len(ranges.file) > len(ranges.paths):
        return splits.read_ranges(spark, ranges, len(names[0]), max_n_reads, lambda lines, path: records_of(lines, path, max_read_length), READS, BATCH)
    spark.dataSource.register(FastqSource)
    reader = spark.read.format("fastq").option("forward", "\n".join(names[0])).option("maxReadLength", str(max_read_length))
    if names[1]:
        reader = reader.option("reverse", "\n".join(names[1]))
    if max_n_reads >= 0:
        reader = reader.option("maxNReads", str(max_n_reads))
    reads = reader.load()
    if len(names[0]) > 1:
        # number the reads across files: offsets are the sizes of the files before, one row a file
        sizes = reads.groupBy("file_idx").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sizes.select("file_idx", F.coalesce(before, F.lit(0)).alias("offset"))
        reads = reads.join(F.broadcast(offsets), "file_idx").withColumn("read_idx", F.col("read_idx") + F.col("offset")).drop("offset")
        if max_n_reads >= 0:
            reads = reads.where(F.col("read_idx") < max_n_reads)
    return reads.select("file_idx", "read_idx", "seq1", "qual1", "seq2", "qual2")


def fastq_lines(filtered: DataFrame, mate: int) -> DataFrame:
    """One string per filtered read: the four lines of its record, raw bases and all (columns read_idx, label, seqN, qualN)."""
    text = F.concat(F.lit("@S"), F.col("read_idx").cast("string"), F.lit("_"), F.col("label"), F.lit(f" {mate}\n"), F.col(f"seq{mate}"), F.lit("\n+\n"), F.col(f"qual{mate}"))
    return filtered.sortWithinPartitions("read_idx").select(text.alias("value"))


def write_filtered(filtered: DataFrame, forward: str, reverse: str | None = None) -> None:
    """Gzip FASTQ of the filtered reads, one file for each mate: tasks write gzip members, which are then put one after the other
    (a stream of bytes of bounded buffer; a single file has a single writer)."""
    spark = filtered.sparkSession
    for mate, path in ((1, forward), (2, reverse)):
        if path:
            parts = scratch.path(spark)
            fastq_lines(filtered, mate).write.option("compression", "gzip").text(parts)
            scratch.concatenate(spark, parts, ".gz", path)
