"""Helpers shared by the operators: tables, scratch tables in the shared folder, digests."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark, so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mavelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, as Spark resolves it: Arrow's file systems in the tasks then mean the same place."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: later stages never recompute it, even after a lost executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """Tables that a computation writes on its way, to be deleted when it has its result."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(cut(df, label))
        return self.tables[-1]

    def clear(self, *but: DataFrame) -> None:
        """Delete all tables but those that the result still reads."""
        for x in self.tables:
            if not any(x is y for y in but):
                discard(x)
        self.tables = [*but]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *forget: Callable[[], None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which waits for its next task, drops its tables (by the functions of forget) and
    gives freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and about so many bytes, to bound the Python objects alive at once."""
    step = max(1, min(rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


#: Bits of a Bloom filter of ids: 2**18 rows of 64 bits, whatever the number of ids.
BLOOM_BITS = 24


def _bit(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(1 << BLOOM_BITS))


def bloom(ids: DataFrame, id_col: str) -> DataFrame:
    """A table (slot, bits) of fixed size that tells for most other ids that they aren't among these."""
    at = ids.select(_bit(id_col).alias("_bf_at")).select((F.col("_bf_at") / 64).cast("int").alias("_bf_slot"), F.expr("shiftleft(1L, cast(_bf_at % 64 AS int))").alias("b"))
    return cut(at.groupBy("_bf_slot").agg(F.bit_or("b").alias("_bf_bits")), "bloom")


def maybe_in(df: DataFrame, id_col: str, filter_: DataFrame, out: str) -> DataFrame:
    """df with a flag that is true for all ids of the filter and, by chance, for a few others (null ids: false)."""
    flagged = df.withColumn("_bf_at", _bit(id_col)).withColumn("_bf_slot", (F.col("_bf_at") / 64).cast("int"))
    flagged = flagged.join(F.broadcast(filter_), "_bf_slot", "left")  # at most 2**18 rows
    hit = F.expr("(_bf_bits & shiftleft(1L, cast(_bf_at % 64 AS int))) <> 0")
    return flagged.withColumn(out, F.coalesce(hit, F.lit(False)) & F.col(id_col).isNotNull()).drop("_bf_at", "_bf_slot", "_bf_bits")
