"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's features are the hashed distinct words of its text, their hashed starts, and a few hashed marks of its shape (shouting, repetition,
punctuation). All grades share one weight per feature; ordered thresholds turn the score s into P(grade > k) =
sigmoid(s - t_k), which gives the expected grade and the tail probability P(grade >= top) for selection.

The model is fitted on the driver from a bounded sample of rated rows: the `sample_rows` rated documents whose hashed ids
are smallest (a documented parameter; it doesn't grow with the corpus). Only those ids are broadcast to find their texts.
Every document is scored whole.

Defined cases: null and empty texts have no words and are scored by the marks alone; null ids and null ratings take no
part in the fit; an id that is rated more than once is used with each of its ratings; without any rated row, all grades
are equally likely; repeated rows get equal scores; other columns are kept and output columns replace any of their name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: ASCII other than letters and digits ends a word.
BREAKS = {b: " " for b in range(128) if not chr(b).isalnum()}
CAPS = regex.compile(r"\p{Lu}{2,}").findall
MARKS = 1 << 10
#: Letters of a word's start that are a feature as well, so that inflected forms count together.
STEM = 4


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of each hashed feature
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


class Features:
    """Distinct hashed features of a text; words are hashed once while they stay in a bounded cache."""

    def __init__(self, bits: int, cache_words: int = 100_000):
        self.size, self.cache, self.cache_words = 1 << bits, {}, cache_words

    def of(self, text: str | None) -> list[int]:
        text = text or ""
        found = text.translate(BREAKS).split()
        lower = [*map(str.lower, set(found))]
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
        out = set()
        for w in lower:
            h = cache.get(w)
            if h is None:
                h = cache[w] = tuple(MARKS + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (self.size - MARKS) for x in (w, " " + w[:STEM]))
            out.update(h)
        n = len(found)
        level = lambda x: int(np.log2(1 + x))
        same = sum(map(str.__eq__, found, found[1:]))
        shape = (level(n), level(same), min(9, 10 * same // max(1, n)), level(text.count("!!")), min(9, 10 * len(CAPS(text)) // max(1, n)), min(9, 10 * (n - len(set(found))) // max(1, n)), min(15, len(text) // max(1, n)))
        out.update(64 * i + min(63, x) for i, x in enumerate(shape))
        return sorted(out)


def screened(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, size: int, least_rows: int) -> np.ndarray:
    """Features whose share of low grades differs from the common share by sqrt(2 ln n) standard deviations for n rated
    rows, the level that n draws of noise hardly reach; marks always."""
    least_z = np.sqrt(2 * np.log(max(2, len(grades))))
    n = np.bincount(flat, minlength=size)
    keep = np.arange(size) < MARKS
    for k in range(n_grades - 1):
        low = np.bincount(flat, grades[row] <= k, size)
        share = np.clip(low.sum() / max(1, len(flat)), 1e-6, 1 - 1e-6)
        keep |= np.abs(low - n * share) > least_z * np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return keep & (n >= least_rows)


def fit(flat: np.ndarray, row: np.ndarray, grades: np.ndarray, n_grades: int, bits: int, steps: int = 250, rate: float = 0.05, l2: float = 1e-4, least_rows: int = 2) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty by Adam over all rows: feature flat[i] belongs to row[i]. Features
    that say nothing of the grade by themselves weigh nothing: most words are rare, and fitting them would only learn the
    sample by heart."""
    size, k = 1 << bits, n_grades - 1
    if not len(grades):
        return OrdinalModel(np.zeros(size), np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1)))
    used = screened(flat, row, grades, n_grades, size, least_rows)
    row, flat = row[used[flat]], flat[used[flat]]
    names, flat = np.unique(flat, return_inverse=True)
    n = len(grades)
    above = np.array([np.mean(grades > j) for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    theta = np.concatenate([np.zeros(len(names)), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    w = len(names)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([theta[w : w + 1], np.exp(theta[w + 1 :])]))
        score = np.bincount(row, theta[:w][flat], n)
        cum = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -40, 40)))  # P(grade > j)
        edge = np.column_stack([np.ones(n), cum, np.zeros(n)])
        p = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
        slope = np.column_stack([np.zeros(n), cum * (1 - cum), np.zeros(n)])
        lo, hi = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = -(lo - hi) / p / n
        by_t = np.zeros((n, n_grades + 1))
        by_t[np.arange(n), grades] += lo / p / n
        by_t[np.arange(n), grades + 1] -= hi / p / n
        g_t = by_t[:, 1:-1].sum(0)
        tail = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate([np.bincount(flat, by_score[row], w) + l2 * theta[:w], tail[:1], tail[1:] * np.exp(theta[w + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[names] = theta[:w]
    return OrdinalModel(weights, np.cumsum(np.concatenate([theta[w : w + 1], np.exp(theta[w + 1 :])])))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8192, bits: int = 18) -> OrdinalModel:
    """Fit on the bounded sample: `grade` is a column of ratings that holds 0 .. n_grades - 1."""
    rated = ratings.select(F.col(id_col).alias("_q_id"), grade.cast("int").alias("_q_grade")).where(F.col("_q_id").isNotNull() & F.col("_q_grade").between(0, n_grades - 1))
    sample = rated.orderBy(F.xxhash64("_q_id"), "_q_id", "_q_grade").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_q_id"), F.col(text_col).alias("_q_text")).join(F.broadcast(sample), "_q_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for whole in batches:
            for b in common.slices(whole, 4096):
                found = [features.of(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1), b.column(2)], ["f", "g", "i"])

    rows = texts.select("_q_text", "_q_grade", F.col("_q_id").cast("string")).mapInArrow(common.tidy(run), "f array<int>, g int, i string").toArrow().sort_by([("i", "ascending"), ("g", "ascending")])
    lists = rows.column("f").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # flat arrays: the sample's features are many
    row = np.repeat(np.arange(rows.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    grades = rows.column("g").to_numpy().astype(np.int64)
    del rows, lists
    return fit(flat, row, grades, n_grades, bits)


def score(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with `score`, `expected_grade` and `p_top`, the probability of the highest grade."""
    out = ("score", "expected_grade", "p_top")
    kept = [f for f in df.schema.fields if f.name not in out and (keep is None or f.name in keep)]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(model)
    alias = "_q_text_in"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        features = Features(int(np.log2(len(m.weights))))
        weights = m.weights
        for whole in batches:
            for b in common.slices(whole, 4096):
                s = np.array([weights[features.of(t)].sum() for t in b.column(alias).to_pylist()], float)
                tails = m.tails(s) if len(s) else np.zeros((0, len(m.thresholds)))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s), pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*names, *out])

    schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in out)])
    return df.select(*(F.col(f"`{n}`") for n in names), F.col(text_col).alias(alias)).mapInArrow(common.tidy(run), schema)


def grade_of_labels() -> Column:
    """0: rated toxic, 1: rated of low quality, 2: neither; null where a rating is missing."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def digests(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: expected grade, probability of being clean, and whether it is selected."""
    model = train(docs, labels, grade_of_labels(), 3)
    return score(docs.select("doc_id", "text"), model, keep=["doc_id"]).withColumn("selected", F.col("p_top") >= least)
