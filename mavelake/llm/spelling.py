"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Candidates come from positional q-gram indexes. Two words one edit apart agree before the edit and after it, so they share
either their first or their last half: each word goes to the buckets of its halves (for itself as the shorter or as the
longer of a pair), and a bucket is one index. In it, a word's postings are merged by a heap under the limits of length (at
most one apart) and position (at most one apart); only the q + 1 shortest lists need merging, as a pair that reaches the
overlap bound (all q-grams of the longer but the q that one edit can touch) can't miss all of these. What reaches the bound
over all q-grams is verified by comparing the words.

A bucket of more than BUCKET words is split: the middle, where its pairs may differ, is halved again, and each word goes to
the bucket that also fixes the left and to that which also fixes the right half of it. This ends at the latest where one
character is left, so buckets are bounded by the alphabet, whatever words the corpus has. A pair is found in exactly one
bucket: that whose middle holds the end of its common prefix.

Defined cases: null texts have no words; a null id counts as an empty one; repeated rows count again; tables without words
give no rows; runs of any length are words. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters that make up words (fixed values of the query's contract), and the least length of a word.
LETTERS, LEAST_LENGTH = r"[A-Za-zÀ-ÿ]", 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a gram, and words of a bucket above which it is split.
Q, BUCKET = 2, 1024


def common_prefix(s: str, t: str) -> int:
    n = min(len(s), len(t))
    if s[:n] == t[:n]:
        return n
    return next(i for i in range(n) if s[i] != t[i])


def edit_place(s: str, t: str) -> int | None:
    """Where two words of which s isn't the longer differ by exactly one edit: their common prefix; else None."""
    i = common_prefix(s, t)
    if len(s) == len(t):
        return i if i < len(s) and s[i + 1 :] == t[i + 1 :] else None
    return i if len(t) == len(s) + 1 and s[i:] == t[i + 1 :] else None


def near_places(found: list[tuple[int, int]], first: int, place: int) -> Iterator[int]:
    """The words of a posting list, from the given one on, that have the gram at most one place away."""
    return (i for i, at in found[bisect_left(found, (first, 0)) :] if -1 <= at - place <= 1)


def index_pairs(words: list[str], q: int = Q) -> Iterator[tuple[int, int, int]]:
    """(i, j, place) for all pairs of words one edit apart, words in order of their lengths, i before j."""
    lengths = [len(w) for w in words]
    postings: dict[str, list[tuple[int, int]]] = {}  # gram -> (word, place), ascending
    places: list[dict[str, list[int]]] = []
    final = len(words) - 1
    for j, w in enumerate(words):
        n = len(w)
        grams = [w[p : p + q] for p in range(n - q + 1)]
        first = bisect_left(lengths, n - 1)
        candidates: Iterator[int] = iter(())
        if first < j and n + 1 > 2 * q:
            lists = [(found, p) for p, g in enumerate(grams) if (found := postings.get(g))]
            # grams that no word before has are missing in each of them: with more than q, none reaches the bound
            spare = q + 1 - (len(grams) - len(lists))
            if spare > 0:
                if len(lists) > spare:  # the shortest lists, each from the first word that is long enough
                    lists.sort(key=_size)
                candidates = heapq.merge(*(near_places(found, first, p) for found, p in lists[:spare]))
        elif first < j:
            candidates = iter(range(first, j))
        last = -1
        for i in candidates:
            if i == last:
                continue
            last = i
            if n + 1 > 2 * q and not _reaches(places[i], grams, q):
                continue
            place = edit_place(words[i], w)
            if place is not None:
                yield i, j, place
        if j < final:
            own: dict[str, list[int]] = {}
            for p, g in enumerate(grams):
                own.setdefault(g, []).append(p)
                postings.setdefault(g, []).append((j, p))
            places.append(own)


def _size(x: tuple[list, int]) -> int:
    return len(x[0])


def _reaches(theirs: dict[str, list[int]], grams: list[str], spare: int) -> bool:
    """Whether all but so many of the grams are at most one place away in the other word."""
    for p, g in enumerate(grams):
        for at in theirs.get(g, ()):
            if -1 <= at - p <= 1:
                break
        else:
            if not spare:
                return False
            spare -= 1
    return True


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's two buckets that fix half of the middle (all but `a` characters in front and `b` behind)."""
    h = F.expr("(m - a - b) div 2").cast("int")
    both = F.array(F.struct((F.col("a") + h).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - h).alias("b")))
    rows = rows.select("word", "n", "m", F.explode(F.array_distinct(both)).alias("x")).select("word", "n", "m", "x.a", "x.b")
    # a hash may put two buckets together, which only adds words that are then told apart
    return rows.withColumn("key", F.expr("xxhash64(m, a, b, substring(word, 1, a), substring(word, length(word) - b + 1, b))"))


def buckets(words: DataFrame, scratch: common.Scratch, most: int = BUCKET) -> DataFrame:
    """(key, m, a, b, word, n): every word with the buckets that it is indexed in, none of more than `most` words unless one
    character is left of its middle. m is the length of the shorter word of the bucket's pairs."""
    n = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("m")).where("m >= 0").select("word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows = scratch.cut(_halves(rows), "buckets")
    kept = []
    while True:
        large = scratch.cut(rows.where("m - a - b > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most).select("key"), "large-buckets")
        if large.isEmpty():
            kept.append(rows)
            break
        divisible = F.col("m") - F.col("a") - F.col("b") > 1
        # no hint: the written table's size decides whether it is broadcast
        kept += [rows.where(divisible).join(large, "key", "left_anti"), rows.where(~divisible)]
        rows = scratch.cut(_halves(rows.where(divisible).join(large, "key", "left_semi")), "buckets")
    out = kept[0].select("key", "m", "a", "b", "word", "n")
    for x in kept[1:]:
        out = out.union(x.select("key", "m", "a", "b", "word", "n"))
    return out


def near_pairs(words: DataFrame, scratch: common.Scratch, q: int = Q, most: int = BUCKET) -> DataFrame:
    """(word, other, other_n) for all words one edit apart, both ways; `words` has distinct words with counts n."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def found(rows: list[tuple], out: list[tuple]) -> None:
            if len(rows) < 2:
                return
            by_state: dict[tuple, list[tuple]] = {}
            for _, m, a, b, word, n in rows:  # one state but for equal hashes
                by_state.setdefault((m, a, b), []).append((len(word), word, n))
            for (m, a, b), some in by_state.items():
                some.sort()
                for i, j, place in index_pairs([w for _, w, _ in some], q):
                    # here belong pairs whose shorter word has m letters and whose edit is in the middle
                    if some[i][0] == m and a <= place and (place < m - b or not b):
                        (_, s, s_n), (_, t, t_n) = some[i], some[j]
                        out += [(s, t, t_n), (t, s, s_n)]

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    found(held, out)
                    held.clear()
                held.append(row)
            yield pd.DataFrame(out, columns=["word", "other", "other_n"])
        out = []
        found(held, out)
        yield pd.DataFrame(out, columns=["word", "other", "other_n"])

    dealt = buckets(words, scratch, most).repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(common.tidy(run), "word string, other string, other_n long")


def variants(words: DataFrame, ratio: int = 10, q: int = Q, most: int = BUCKET) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of distinct words with counts n (not null).

    A word's form is its near word of largest n (ties: the smallest), if that is at least ratio times the word's own n; its
    root is where following forms ends."""
    scratch = common.Scratch()
    near = near_pairs(words, scratch, q, most)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    enough = -F.col("best.minus") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")
    )
    judged = scratch.cut(judged, "forms")
    chain = scratch.cut(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "chain")
    top = judged.agg(F.max("n").alias("n")).collect()[0].n or 1
    steps = int(math.log(top, max(ratio, 2))) + 1  # each form has at least ratio times as many, so chains are no longer
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        # jump twice as far in each round
        ahead = chain.toDF("root", "further")
        chain = scratch.cut(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chain")
    result = common.cut(judged.join(chain, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root")), "variants")
    scratch.clear()
    return result


def occurrences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): the maximal runs of at least LEAST_LENGTH letters of each text, A-Z in lower case (shorter ones can't become words)."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{LEAST_LENGTH},}}"), F.lit(0))
    return df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(id_: Column, run: Column) -> Column:
    """The run, from which a letter is deleted if 31 divides the hash of id and run."""
    h = F.crc32(F.encode(F.concat(id_, F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the texts, with letters deleted by hash, of at least two occurrences: near words, forms and roots."""
    seen = occurrences(df, id_col, text_col).select(misspelt(F.col("id"), F.col("run")).alias("word"))
    words = common.cut(seen.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"), "words")
    out = variants(words)
    common.discard(words)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
