"""Cutting lineage: tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir (or a folder of our own where it is unset in local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mavelake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"


def files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """The files of a folder with that suffix, in order of their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(n for n in (re.sub("^file:/(?!/)", "file:///", x.getPath().toString()) for x in found) if n.endswith(suffix))


def concatenate(spark: SparkSession, folder: str, suffix: str, target: str) -> None:
    """Put the files of a folder together as one, in order of their names, and delete the folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    goal = hadoop.fs.Path(target)
    out = goal.getFileSystem(conf).create(goal, True)
    for name in files(spark, folder, suffix):
        part = hadoop.fs.Path(name)
        source = part.getFileSystem(conf).open(part)
        hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
    where = hadoop.fs.Path(folder)
    where.getFileSystem(conf).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to a new path in the shared folder and read it again."""
    where = path(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
