"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the share of its host's pages that contain it; lines whose ratio exceeds a
limit, on at least so many pages, are boilerplate there and are dropped from all pages of the host.

The counts are pre-aggregated before their shuffle, so a hot host or a very common line costs one row per task. At most
(distinct lines per page) / max_ratio lines of a host can be boilerplate, which bounds the list that is joined back. The lists are
written to the shared folder first, so Spark knows their size: it broadcasts them under its own limit and otherwise splits
the skewed hosts of a join of two plain exchanges.

Defined cases: null texts stay null and have no lines; blank lines are neither counted nor dropped; a line that repeats
in a page counts once there; a null host counts as an empty one; lines are told apart by two independent hashes (96 bits)
of their trimmed text; texts are taken whole; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HOST, KEYS = "_ld_host", "_ld_keys"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    t = F.trim(line)
    return F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"))


def boilerplate(df: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """Per host that has any: the keys of its boilerplate lines."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias(HOST)
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != ""), _key))
    counts = df.select(host, F.explode(keys).alias("k")).groupBy(HOST, "k").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = df.groupBy(host).agg(F.count("*").alias("pages"))
    return counts.join(pages, HOST).where(F.col("n") > max_ratio * F.col("pages")).groupBy(HOST).agg(F.collect_list("k").alias(KEYS))


def drop_lines(df: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = 0.05, min_pages: int = 5, lines_col: str | None = None, dropped_col: str | None = None) -> DataFrame:
    """df without boilerplate lines in its text; lines_col and dropped_col, if named, count all lines and dropped ones."""
    names = df.columns
    lists = common.cut(boilerplate(df, text_col, host_col, max_ratio, min_pages), "boilerplate")  # of known size: broadcast only if small
    joined = df.withColumn(HOST, F.coalesce(F.col(host_col).cast("string"), F.lit(""))).join(lists, HOST, "left")
    all_lines = _lines(F.col(text_col))
    kept = F.when(F.col(KEYS).isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(KEYS), _key(x))))
    joined = joined.withColumn("_ld_kept", kept)
    counts = [c for c in (lines_col and F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias(lines_col), dropped_col and F.coalesce(F.size(all_lines) - F.size("_ld_kept"), F.lit(0)).cast("long").alias(dropped_col)) if c is not None]
    return joined.select(*(F.array_join("_ld_kept", "\n").alias(n) if n == text_col else F.col(f"`{n}`") for n in names), *counts)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    out = drop_lines(df.select(id_col, "text", "source"), lines_col="n_lines", dropped_col="n_dropped")
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH doc AS (SELECT doc_id, text, coalesce(source, '') AS host FROM documents),
line AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
pages AS (SELECT host, count(*) AS pages FROM doc GROUP BY host),
freq AS (SELECT host, trim(line, ' ') AS t, count(DISTINCT doc_id) AS n FROM line WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
boiler AS (SELECT host, t FROM freq JOIN pages USING (host) WHERE n >= 5 AND n > 0.05 * pages),
judged AS (SELECT l.doc_id, l.line, l.pos, b.t IS NOT NULL AS gone FROM line l LEFT JOIN boiler b ON b.host = l.host AND b.t = trim(l.line, ' ')),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM judged GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k USING (doc_id)
"""
