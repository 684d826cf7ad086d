"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. The document frequencies df of five-word shingles are counted over all N documents, exactly for all shingles in at least a
   hundredth of them (`SHARE`), which are few, whatever the corpus. The weight of a shingle is its count in the text times
   ln(1 + N / df); rarer shingles weigh alike, as in a hundredth. (So an edit, which makes new shingles, doesn't weigh more
   than what a group of copies shares, unless the group is more than a hundredth of the corpus.)
2. Each text gets samples (improved consistent weighted sampling) that agree with the probability of the weighted Jaccard
   similarity; BANDS bands of ROWS samples each are its bucket keys. Texts with equal words are collapsed to one first, and of
   buckets with the same members one is kept.
3. All pairs of a bucket are verified by their exact weighted Jaccard similarity over the whole texts, block by block: the
   texts of a block are brought together once, and the weights that any two of them share are one matrix product. A block
   returns only such similar pairs as connect its members, fewer than it has members.
4. Connected components of these links are the classes; a class is named by its smallest id.

Large groups are safe: equal texts meet in pre-aggregated minima. A bucket of more than GROUP members is dealt out in parts,
each with about REPS of the same members of the bucket, which connects most of what is similar at linear cost; then parts that
still hold different classes meet each other, part by part, so that no pair of different classes in a bucket is left
unverified. Joins on hot buckets or ids are joins of plain exchanges, which adaptive execution splits.

The method is probabilistic only in step 2: a pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS
(0.998 at 0.8); tests measure pairs and classes against brute force.

Defined cases: null, empty and wordless texts are alone in their class; texts are taken whole; a text of fewer than five
words is one shingle; repeated ids count as one document each row and share a class; null ids keep their own row with a
null class; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import HASH_BITS, MAX_TEXTS, bags, forget, mix

WIDTH, SLOTS = 1 << 19, 256
BANDS, ROWS = 12, 4
#: Shingles in less than this share of the documents weigh alike; and how many are listed with their frequencies at most.
SHARE, LISTED = 0.01, 1 << 19
POOL_BITS = 15
#: Members of a part of a bucket, and about how many members all parts have in common.
GROUP, REPS = 256, 12
#: Shared shingles of a block that are compared in one matrix product.
COLUMNS = 4096
#: Bytes of text that are hashed together: the arrays take about fifty times that.
SLICE = 1 << 20
#: Most shingles that are sampled together, so that the arrays stay in a core's cache.
RUN = 1 << 16


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - 19)).astype(np.int64)


@dataclass
class Idf:
    """Inverse document frequencies: ln(1 + N / df), where a df below `least` counts as `least`.

    Only the frequent shingles are listed, with their exact frequencies; `heavy` tells which counters have any."""

    n: float
    least: float
    heavy: np.ndarray
    names: np.ndarray
    df: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        df = np.full(len(h), self.least)
        at = np.flatnonzero(self.heavy[_counter(h)])
        if len(at) and len(self.names):
            place = np.minimum(np.searchsorted(self.names, h[at]), len(self.names) - 1)
            known = self.names[place] == h[at]
            df[at[known]] = self.df[place[known]]
        return np.log1p(self.n / df).astype(np.float32)


def frequencies(docs: DataFrame, text_col: str = "text", share: float = SHARE) -> Idf:
    """Exact document frequencies of all shingles in at least a share of the documents.

    Hashed counters of fixed size bound the frequencies from above; a second pass counts the shingles of heavy counters
    exactly. The mean number of shingles a document over the share bounds how many can be frequent; where documents are so
    long that this is more than LISTED, the share is raised until it isn't."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(WIDTH, np.int64), 0
        for whole in batches:
            for b in common.slices(whole, MAX_TEXTS, SLICE):
                _, h, _, _ = bags(b.column(0).to_pylist())
                table += np.bincount(_counter(h), minlength=WIDTH)
                n += b.num_rows
        if n:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(table, SLOTS)]
            yield pa.RecordBatch.from_arrays([pa.array([*range(SLOTS), -1], pa.int32()), pa.array([*parts, zlib.compress(np.array([n], np.int64).tobytes())], pa.binary())], ["slot", "counts"])

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in rows:
            for x in part["counts"]:
                y = np.frombuffer(zlib.decompress(x), np.int64)
                total = y.copy() if total is None else total + y
        yield pd.DataFrame({"slot": [key[0]], "counts": [total.tobytes()]})

    parts = docs.select(text_col).mapInArrow(common.tidy(count, forget), "slot int, counts binary")
    found = {r.slot: np.frombuffer(bytes(r.counts), np.int64) for r in parts.groupBy("slot").applyInPandas(add, "slot int, counts binary").collect()}  # of fixed size
    none = np.zeros(0, np.uint64)
    if -1 not in found:
        return Idf(1.0, 1.0, np.zeros(WIDTH, bool), none, none.astype(float))
    table, n = np.concatenate([found[i] for i in range(SLOTS)]), float(found[-1][0])
    least = max(2.0, share * n, table.sum() / LISTED)
    heavy = table >= least
    if not heavy.any():
        return Idf(n, least, heavy, none, none.astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for whole in batches:
            for b in common.slices(whole, MAX_TEXTS, SLICE):
                _, h, _, _ = bags(b.column(0).to_pylist())
                h, k = np.unique(h[heavy[_counter(h)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(k)], ["h", "n"])

    counts = docs.select(text_col).mapInArrow(common.tidy(exact, forget), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    listed = counts.where(F.col("n") >= least).orderBy("h").toArrow()  # at most LISTED rows
    return Idf(n, least, heavy, listed.column("h").to_numpy().astype(np.uint64), listed.column("n").to_numpy().astype(float))


class Sampler:
    """Improved consistent weighted sampling with parameters from pools of random numbers, chosen by the shingle's hash."""

    def __init__(self, samples: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = (samples, 1 << POOL_BITS)
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.per_r = (1 / self.r).astype(np.float32)
        self.times = rng.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)

    def of(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of 32-bit samples for each text; a text's shingles begin at starts."""
        out = np.empty((len(starts), len(self.times)), np.uint64)
        log_w = np.log(weight).astype(np.float32)
        for k, times in enumerate(self.times):
            x = h * times
            at = (x >> np.uint64(64 - POOL_BITS)).astype(np.int64)
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(log_w * self.per_r[k][at] + beta)
            a = self.log_c[k][at] - r * (t - beta + np.float32(1))
            bits = a.view(np.int32)
            order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32
            name = (x >> np.uint64(8)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[:, k] = (np.minimum.reduceat(order | name.astype(np.int64), starts) & 0xFFFFFFFF).astype(np.uint64)
        return out


def signatures(docs: DataFrame, idf: Idf, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, two digests of its words (null without words) and its bucket keys."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sampler = shared.value, Sampler(BANDS * ROWS)
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for whole in batches:
            for b in common.slices(whole, MAX_TEXTS, SLICE):
                text, h, count, digest = bags(b.column(1).to_pylist())
                keys: list = [None] * b.num_rows
                second = np.zeros(b.num_rows, np.uint64)
                if len(text):
                    starts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                    second[text[starts]] = np.add.reduceat(mix(h + count.astype(np.uint64)), starts)
                    weight = idf.of(h) * count
                    edges = [0, *np.flatnonzero(np.diff(starts // RUN)) + 1, len(starts)]
                    for lo, hi in zip(edges, edges[1:], strict=False):
                        a, z = starts[lo], starts[hi] if hi < len(starts) else len(h)
                        s = sampler.of(h[a:z], weight[a:z], starts[lo:hi] - a)
                        s = s.reshape(hi - lo, BANDS, ROWS)
                        key = np.broadcast_to(salt, (hi - lo, BANDS)).copy()
                        for row in range(ROWS):
                            key = mix(key * np.uint64(31) + s[:, :, row])
                        for i, k in zip(text[starts[lo:hi]].tolist(), key.view(np.int64).tolist(), strict=True):
                            keys[i] = k
                none = digest == 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest.view(np.int64), mask=none), pa.array(second.view(np.int64), mask=none), pa.array(keys, pa.list_(pa.int64()))], ["id", "d1", "d2", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(run, forget), f"id {kind}, d1 long, d2 long, keys array<long>")


def similarities(texts: list[str], idf: Idf) -> np.ndarray:
    """The weighted Jaccard similarity of any two texts."""
    n = len(texts)
    owner, name, weight = [], [], []
    at, size = 0, 0
    for i in range(n + 1):  # bags of about SLICE bytes of text at once
        if i == n or (i > at and (size + len(texts[i]) > SLICE or i - at >= MAX_TEXTS)):
            text, h, count, _ = bags(texts[at:i])
            w = idf.of(h).astype(float)
            turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # a repeated shingle is as many shingles
            owner.append(np.repeat(text + at, count))
            name.append(mix(np.repeat(h, count) + (turn.astype(np.uint64) << np.uint64(HASH_BITS))))
            weight.append(np.repeat(w, count))
            at, size = i, 0
        size += len(texts[i]) if i < n else 0
    owner, name, weight = (np.concatenate(x) for x in (owner, name, weight))
    total = np.bincount(owner, weight, n)
    by = np.argsort(name, kind="stable")
    owner, name, weight = owner[by], name[by], weight[by]
    new = np.append(True, name[1:] != name[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # what is in one text alone is in no intersection
    owner, weight, column = owner[shared], weight[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])[: len(column)]) - 1
    both = np.zeros((n, n))
    for lo in range(0, (column[-1] + 1) if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((n, COLUMNS))
        m[owner[a:z], column[a:z] - lo] = np.sqrt(weight[a:z])
        both += m @ m.T
    return both / np.maximum(total[:, None] + total[None, :] - both, 1e-12)


def connecting(similar: np.ndarray, classes_: list) -> list[tuple[int, int]]:
    """Similar pairs that join members of different classes, as few as connect all that can be connected."""
    names = {c: i for i, c in enumerate(dict.fromkeys(classes_))}
    at = np.array([names[c] for c in classes_])
    i, j = np.nonzero(np.triu(similar, 1) & (at[:, None] != at[None, :]))
    if not len(i):
        return []
    pair = np.minimum(at[i], at[j]) * len(names) + np.maximum(at[i], at[j])
    one = np.unique(pair, return_index=True)[1]
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(i[one].tolist(), j[one].tolist(), strict=True):
        a, b = find(at[x]), find(at[y])
        if a != b:
            parent[a] = b
            out.append((x, y))
    return out


def components(links: DataFrame, scratch: common.Scratch | None = None) -> DataFrame:
    """(id, class) for every id of the links (a, b): class is the smallest id of its connected component.

    Alternates large and small stars: each round links the neighbours of every node to the smallest of them, so that
    components shrink to stars in a number of rounds logarithmic in their size. Links are stars, and so done, when no node
    with a smaller neighbour has another one; the least neighbours, which a round begins with, tell that too.
    """
    t = scratch or common.Scratch()
    edges = t.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        least = t.cut(least.selectExpr("u", "least(low, u) AS m", "low < u AND low < high AS open"), "least")
        if not least.agg(F.max("open")).first()[0]:
            return edges.union(edges.select(F.col("v").alias("u"), "v")).distinct().toDF("id", "class")
        large = t.cut(both.join(least.drop("open"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = t.cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = t.cut(small, "stars")
        for x in (edges, least, large, low):
            common.discard(x)
            t.tables.remove(x)
        edges = small


def linked(members: DataFrame, texts: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Similar pairs (a, b) of different classes that connect the members of each block (members: band, key, x, y, rep, class)."""
    shared = members.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            ids = [r[4] for r in held]
            similar = similarities([r[6] or "" for r in held], shared.value) >= threshold
            out = [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in connecting(similar, [r[5] for r in held])]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], type_) for k in (0, 1)], ["a", "b"])

        for whole in batches:
            type_ = whole.schema.field(4).type
            for b in common.slices(whole, 1024, SLICE):
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and row[:4] != held[0][:4]:
                        if len(held) > 1:
                            yield found()
                        held = []
                    held.append(row)
        if len(held) > 1:
            yield found()

    kind = members.schema["rep"].dataType.simpleString()
    with_text = members.join(texts.withColumnRenamed("id", "rep").hint("merge"), "rep").select("band", "key", "x", "y", "rep", "class", "text")
    ordered = with_text.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y", "rep")
    return ordered.mapInArrow(common.tidy(run, forget), f"a {kind}, b {kind}").where("a <> b").distinct()


def blocks(members: DataFrame, comp: DataFrame, t: common.Scratch) -> DataFrame:
    """Members of the buckets that hold several classes, dealt so that any two of different classes meet in a block.

    The parts of a bucket's largest class meet those of the rest, and the latter each other, so that a large class with few
    others beside it is hardly repeated."""
    marked = t.cut(members.join(comp.toDF("rep", "class"), "rep", "left").withColumn("class", F.coalesce("class", "rep")), "marked")
    sizes = marked.groupBy("band", "key", "class").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band", "key").agg(F.sum("n").alias("n"), F.max("n").alias("n_big"), F.max_by("class", "n").alias("big")).where("n > n_big")
    sizes = t.cut(sizes.selectExpr("band", "key", "big", f"cast(ceil(n_big / {GROUP}) AS int) AS p_big", f"cast(ceil((n - n_big) / {GROUP}) AS int) AS p_rest"), "open")
    dealt = marked.join(sizes.hint("merge"), ["band", "key"])
    dealt = dealt.withColumn("mine", F.expr("cast(pmod(xxhash64(rep, band), IF(class = big, p_big, p_rest)) AS int)"))
    block = F.expr("""explode(CASE WHEN class = big THEN transform(sequence(0, p_rest - 1), o -> struct(mine AS x, o AS y))
        ELSE concat(transform(sequence(0, p_big - 1), o -> struct(o AS x, mine AS y)),
          transform(sequence(0, p_rest - 1), o -> struct(-1 - least(mine, o) AS x, greatest(mine, o) AS y))) END)""")
    return dealt.select("band", "key", block.alias("block"), "rep", "class").select("band", "key", "block.*", "rep", "class")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: its id, its class, and how many links connect its text to others of the class."""
    t = common.Scratch()
    idf = frequencies(docs, text_col)
    sig = t.cut(signatures(docs, idf, id_col, text_col), "signatures")
    worded = sig.where(F.col("d1").isNotNull() & F.col("id").isNotNull())
    own = t.cut(worded.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "distinct")  # equal words, equal keys
    bucket = t.cut(own.select("rep", F.posexplode("keys").alias("band", "key")), "buckets")
    # the hints keep one plan at every size: these tables grow with the corpus
    sizes = bucket.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("s1"), F.sum(F.xxhash64("rep", F.lit(1)) % (1 << 40)).alias("s2")).where("n > 1")
    sizes = t.cut(sizes.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*", "n"), "bucket-sizes")  # one of those with equal members
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    h = F.pmod(F.xxhash64("rep", "band"), F.lit(1 << 30))
    in_all = (parts > 1) & (F.pmod(h, F.greatest(F.lit(1), F.floor(F.col("n") / REPS)).cast("long")) == 0)
    part = F.explode(F.when(in_all, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(h, parts.cast("long")).cast("int")))).alias("x")
    members = bucket.join(sizes.hint("merge"), ["band", "key"]).select("band", "key", "rep", (parts > 1).alias("split"), in_all.alias("in_all"), part)
    members = t.cut(members.selectExpr("band", "key", "rep", "x", "split", "NOT in_all OR x = 0 AS once"), "members")
    needed = members.select(F.col("rep").alias("id")).distinct()
    # most texts have no candidate: a filter of fixed size keeps them out of the shuffle
    texts = common.maybe_in(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", common.bloom(needed, "id"), "_near")
    texts = t.cut(texts.where("_near").drop("_near").join(needed.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = t.cut(linked(members.select("*", F.lit(0).alias("y"), F.col("rep").alias("class")), texts, idf, threshold), "links")
    comp = components(links, t)
    split = members.where("split AND once").select("band", "key", "rep")  # else all pairs are verified by now
    if not split.isEmpty():
        more = t.cut(linked(blocks(split, comp, t), texts, idf, threshold), "links")
        if not more.isEmpty():
            links = links.union(more)
            comp = components(links, t)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = own.select("d1", "d2", "rep").join(comp.toDF("rep", "class"), "rep", "left").join(degree, "rep", "left")
    named = t.cut(named.select("d1", "d2", F.coalesce("class", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    t.clear(sig, named)
    out = sig.select("id", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the documents that aren't the first (smallest id) of their class; rows with a null id stay."""
    later = common.cut(classes(docs, id_col, text_col, threshold).where(F.col(id_col) != F.col("class_id")).select(id_col).distinct(), "later")
    flagged = common.maybe_in(docs, id_col, common.bloom(later, id_col), "_near_later")
    sure = flagged.where("NOT _near_later").select(docs.columns)
    rest = flagged.where("_near_later").select(docs.columns).join(later.hint("merge"), id_col, "left_anti")
    return sure.unionByName(rest.select(docs.columns))
