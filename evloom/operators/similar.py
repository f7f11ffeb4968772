"""Texts that are alike by edit distance, found exactly without comparing all pairs.

Two texts of lengths n <= m are alike if 100 x distance < (100 - percent) x m.  So the distance is bounded by the length, d, and lengths differ by no more than that.
All grams of q characters have one order, rarest first.  A text's prefix is all that is up to its (q d + 1)th gram; d + 1 of them that don't overlap are its pivots.  d edits can't
touch all pivots, so one of them stands in the other text, within d places; if the other's prefix ends later in the order, then in that prefix.  So texts meet where a pivot of the one is in
the prefix of the other, within bands of length, and candidates are verified once.  Equal texts are one class before that, so copies make no pairs.

Grams are counted in a table of fixed size; a gram's order is its counter, then its hash.  Any order gives the same pairs, a good one makes few candidates: what many texts share is not a pivot
unless a text has little else.  Prefixes are found where the text is, and what is shuffled is a row of numbers for each gram of a prefix.
Tables of grams are larger than the texts that they come from, so joins with them are by sorting: estimated by the texts' size they would be broadcast by the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The longest gram, and counters of grams.
Q, COUNTERS = 10, 1 << 16


def classes(items: DataFrame, key: str, text: str) -> DataFrame:
    """key, rep for each row with a text: rep is the least key with the same text."""
    t = items.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    reps = t.groupBy("_t").agg(F.min(key).alias("rep"))
    return t.join(reps.hint("merge"), "_t").select(key, "rep")


def _most(n, percent: int):
    """The largest distance of a text of n characters to one that is like it, shorter or longer."""
    return (n * (100 - percent) - 1) // percent


def _length(percent: int) -> int:
    """Characters of a gram: so few that every text has grams enough for its prefix."""
    if not 50 <= percent < 100:
        raise ValueError("texts can be alike by 50 to 99 %")
    return min(Q, *(-(-(percent * d + 1) // (100 - percent)) // (d + 1) for d in range(1, 100)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(text: str, q: int) -> np.ndarray:
    """A hash of each gram of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(len(c) - q + 1, 0), np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(h) + i]
    return _mixed(h)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(COUNTERS)).astype(np.int64)


def _pivots(at: np.ndarray, tokens: np.ndarray, q: int, d: int) -> np.ndarray:
    """Which places (ascending) are pivots: the d + 1 rarest of those that don't overlap."""
    free, chosen = -1, []
    for i, p in enumerate(at.tolist()):
        if p >= free:
            chosen.append(i)
            free = p + q
    chosen = np.array(chosen)
    return chosen[np.argsort(tokens[chosen], kind="stable")[: d + 1]]


def _spans(tokens: np.ndarray, at: np.ndarray):
    """Distinct tokens, and the first and last of the places where each stands."""
    by = np.lexsort((at, tokens))
    tokens, at = tokens[by], at[by]
    first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    return tokens[first], at[first], at[np.r_[first[1:] - 1, len(at) - 1]]


def _counts(texts: DataFrame, q: int) -> np.ndarray:
    """How many grams of all texts fall to each counter."""

    def count(batches):
        c = np.zeros(COUNTERS, np.int64)
        for b in batches:
            h = np.concatenate([_grams(t, q) for t in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            c += np.bincount(_counter(h), minlength=COUNTERS)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(c[at])], ["counter", "c"])

    out = np.zeros(COUNTERS, np.int64)
    for r in texts.select("t").mapInArrow(count, "counter long, c long").groupBy("counter").agg(F.sum("c").alias("c")).collect():
        out[r.counter] = r.c
    return out


def _signatures(texts: DataFrame, percent: int, counts: np.ndarray, pivots: bool) -> DataFrame:
    """rep, key, n, last, low, high: a row for each gram of the texts' prefixes, or for each pivot and band of length that partners can be in.

    key is the gram in its band, last where the prefix ends in the order, low and high the first and last place of the gram in the prefix (or among the pivots).
    """
    q = _length(percent)
    step = 1.001 * math.log(100 / percent)
    rank = (np.log2(counts + 1) * 32).astype(np.uint64) << np.uint64(52)
    of = texts.schema["rep"]
    schema = T.StructType([of, *(T.StructField(c, T.LongType()) for c in ("key", "last")), *(T.StructField(c, T.IntegerType()) for c in ("n", "low", "high"))])

    def sign(batches):
        for b in batches:
            rows, parts = [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                n = len(t)
                d = _most(n, percent)
                if d < 1:
                    continue
                h = _grams(t, q)
                tokens = rank[_counter(h)] | (h >> np.uint64(12))
                last = np.partition(tokens, q * d)[q * d]
                at = np.flatnonzero(tokens <= last)
                mine = tokens[at]
                if pivots:
                    keep = _pivots(at, mine, q, d)
                    at, mine = at[keep], mine[keep]
                tokens, low, high = _spans(mine, at)
                band = math.floor(math.log(n) / step)
                for x in (band - 1, band, band + 1) if pivots else (band,):
                    parts.append((_mixed(tokens + np.uint64(0x632BE59BD9B4E019 * (x + 1) % 2**64)), np.full(len(low), last), np.full(len(low), n), low, high))
                    rows.append(np.full(len(low), i))
            if parts:
                key, last, n, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
                rep = b.column("rep").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([rep, pa.array(key.view(np.int64)), pa.array(last.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (n, low, high))], schema.names)

    return texts.select("rep", "t").mapInArrow(sign, schema)


def _candidates(texts: DataFrame, percent: int) -> DataFrame:
    """a, b: distinct pairs of texts that meet."""
    counts = _counts(texts, _length(percent))
    side = lambda pivots, name: _signatures(texts, percent, counts, pivots).select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("rep", "last", "n", "low", "high")))
    met = side(True, "l").join(side(False, "r").hint("merge"), "key")
    d = F.floor((F.greatest("l_n", "r_n") * (100 - percent) - 1) / 100)
    met = met.where((F.col("l_rep") != F.col("r_rep")) & (F.col("l_last") <= F.col("r_last")) & (F.abs(F.col("l_n") - F.col("r_n")) <= d) & (F.col("l_low") <= F.col("r_high") + d) & (F.col("r_low") <= F.col("l_high") + d))
    return met.select(F.least("l_rep", "r_rep").alias("a"), F.greatest("l_rep", "r_rep").alias("b")).distinct()


def links(texts: DataFrame, percent: int = 95) -> DataFrame:
    """a, b, distance: pairs of different texts (rep, t) that are alike; a < b."""
    met = _candidates(texts, percent)
    for side in "ab":
        met = met.join(texts.select(F.col("rep").alias(side), F.col("t").alias(f"{side}_t")).hint("merge"), side)
    most = F.floor((F.greatest(F.length("a_t"), F.length("b_t")) * (100 - percent) - 1) / 100).cast("int")
    met = met.withColumn("most", most).withColumn("distance", F.expr("levenshtein(a_t, b_t, most)")).where("distance > 0")
    return met.select("a", "b", "distance")


def similar(items: DataFrame, key: str, text: str, percent: int = 95) -> DataFrame:
    """key, rep, links: each row's class of equal texts, and how many other classes are alike. Rows without a text are left out."""
    of = classes(items, key, text)
    texts = items.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(key).alias("rep"))
    pairs = links(texts, percent)
    count = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return of.join(count.hint("merge"), "rep", "left").select(key, "rep", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
