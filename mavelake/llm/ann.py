"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and assigned to
the nearest signed axis: that is a vector's cell in each of TABLES tables. A query probes the PROBES best cells of every
table. Vectors and probes meet in their cells, where distances are exact (double precision, original vectors) and each
query keeps its best; the best of all cells are merged. On vectors without structure (nearest neighbours at 0.85 of the mean
distance) a recall of 0.9 takes about half of all rows as candidates (TABLES * PROBES of the 2 * dimension cells of a table,
0.7 of a full scan); on clustered ones fewer probes would do.

Cells larger than `split_rows` vectors or queries are dealt out in parts (there are tables x 2 x padded dimension cells,
so their counts fit on the driver), so a very common vector doesn't gather in one task, and only each part's best
neighbours leave it: no list of all pairs arises. Queries that find fewer than k neighbours this way probe all cells.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different
lengths never meet; ties go to the smaller id; a row whose id is null takes no part; equal vectors are neighbours at
distance 0; other columns are ignored. Repeated ids are taken as one vector if equal, else all of their vectors count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TABLES, PROBES, ROUNDS = 3, 30, 3


def signs(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (TABLES, ROUNDS, dim))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of the rows of x, padded to a power of two."""
    dim = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    for s in signs(dim)[table]:
        y = y * s
        h = 1
        while h < dim:
            y = y.reshape(len(x), -1, 2, h)
            y = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), dim)
            h *= 2
        y = y / np.sqrt(dim)
    return y


def scaled(x: np.ndarray, axis: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x by a power of two, for all of it or each row, so that squares neither overflow nor vanish, and its exponent."""
    power = np.frexp(np.abs(x).max(axis, keepdims=True, initial=0.0))[1]
    return np.ldexp(x, -power), power


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from y; halves, as a difference may be larger than any double."""
    d, power = scaled(np.ldexp(x, -1) - np.ldexp(y, -1), 1)
    return np.ldexp(np.sqrt((d**2).sum(1)), power[:, 0] + 1)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """The best cells of each row in each table, best first: rows x tables x probes."""
    unit = scaled(x, 1)[0]
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    out = []
    for t in range(TABLES):
        y = rotate(unit, t)
        near = np.concatenate([y, -y], 1)
        out.append(np.argsort(-near, axis=1, kind="stable")[:, :probes] if probes > 1 else near.argmax(1)[:, None])
    return np.stack(out, 1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best k of x for each query: query, id and Euclidean distance. A query's own id is no candidate."""
    out_q, out_id, out_d = [], [], []
    power = max(int(scaled(part)[1].max(initial=-1100)) for part in (x, q))
    fair = np.ldexp(x, -power)
    norms = (fair * fair).sum(1)
    rounding, vanished = 8 * (x.shape[1] + 4) * np.finfo(float).eps, 8 * (x.shape[1] + 4) * np.finfo(float).tiny
    for lo in range(0, len(q), 256):
        block = q[lo : lo + 256]
        fair_block = np.ldexp(block, -power)
        size = (fair_block * fair_block).sum(1)
        rough = size[:, None] + norms - 2 * fair_block @ fair.T
        for i, row in enumerate(rough):
            own = ids == query_ids[lo + i]
            row[own] = np.inf
            n = len(row) - int(own.sum())
            if n > k:
                slack = rounding * (size[i] + norms) + vanished  # how far a rough square can be from the true one
                limit = np.partition(row + slack, k - 1)[k - 1]
                near = np.flatnonzero(row - slack <= limit)
            else:
                near = np.flatnonzero(~own)
            d = distances(x[near], block[i])
            best = np.lexsort((ids[near], d))[: k + 1]  # one more, for repeated ids
            out_q.append(np.full(len(best), query_ids[lo + i]))
            out_id.append(ids[near][best])
            out_d.append(d[best])
    cat = lambda a, t: np.concatenate(a) if a else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_id, np.int64), cat(out_d, float)


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, split_rows: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that meet the condition is_query, against all other rows."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    found = _probe(base, base.where("q"), k, probes, split_rows)
    found = common.cut(found, "nearest")
    n = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    few = base.where("q").join(n.withColumnRenamed("query_id", "id"), "id", "left_anti")
    few = common.cut(few, "few")
    if not few.isEmpty():
        rest = _probe(base, few, k, 1 << 30, split_rows)
        found = found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def _probe(base: DataFrame, queries: DataFrame, k: int, probes: int, split_rows: int) -> DataFrame:
    sc = base.sparkSession.sparkContext

    def place(limit: int, parts=None):
        """Rows for each cell: with parts, one for each part of the other side too."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split = parts.value if parts else None
            for whole in batches:
                for b in common.slices(whole, 2048):
                    ids = b.column(0).to_numpy(zero_copy_only=False)
                    for rows, x in _by_length(b.column(1)):
                        top = cells(x, limit)
                        if split is None:  # counts only
                            key, n = np.unique(np.arange(TABLES)[None, :, None] + TABLES * top, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), x.shape[1]), pa.int32()), pa.array(key, pa.int32()), pa.array(n, pa.int64())], ["dim", "cell", "n"])
                            continue
                        key = np.arange(TABLES)[None, :, None] + TABLES * top
                        at, cell = np.repeat(np.arange(len(rows)), key[0].size), key.reshape(-1)
                        own, other = np.array([split.get((x.shape[1], int(c)), (1, 1)) for c in range(cell.max() + 1)]).T[[0, 1] if limit == 1 else [1, 0]]
                        copies = other[cell]
                        at, cell = np.repeat(at, copies), np.repeat(cell, copies)
                        turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                        mine = (ids[rows[at]] * 2654435761 >> 7) % own[cell]
                        part = mine * other[cell] + turn if limit == 1 else turn * own[cell] + mine
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1]), pa.int32()), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(ids[rows[at]], pa.int64()), pa.array(list(map(bytes, x[at])), pa.binary())], ["dim", "cell", "part", "id", "x"])

        return run

    count = lambda df, limit: {(r.dim, r.cell): r.n for r in df.select("id", "x").mapInArrow(place(limit), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}
    most, asked = count(base, 1), count(queries, probes)
    parts = sc.broadcast({c: (-(-most.get(c, 1) // split_rows), -(-asked.get(c, 1) // split_rows)) for c in most.keys() | asked.keys()})
    shape = "dim int, cell int, part int, id long, x binary"
    stored = base.select("id", "x").mapInArrow(place(1, parts), shape).withColumn("query", F.lit(False))
    probing = queries.select("id", "x").mapInArrow(place(probes, parts), shape).withColumn("query", F.lit(True))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, v = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        matrix = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), -1)
        a, b, d = nearest(v["id"].to_numpy(), matrix(v["x"]), q["id"].to_numpy(), matrix(q["x"]), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": d})

    near = stored.unionByName(probing).groupBy("dim", "cell", "part").applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # a neighbour found in several cells has equal rows, which share a dense rank
    once = near.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
