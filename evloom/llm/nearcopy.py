"""Near copies by SimHash and the exact Jaccard similarity of word shingles (the pipeline's near-dedup).

Two texts are linked where their sets of shingles share 4/5 or more of their union.  SimHash comes first: sets whose
fingerprints differ in two bits or fewer, found by its index of deletion variants, are verified on the whole sets, and
those that are near are one component from then on.  A 64-bit SimHash would have to allow about 17 differing bits
to reach all pairs, which no index of segments narrows down; so those that are still apart meet by a prefix filter, which
loses no pair: in any one order of all shingles, two such sets share one of the first n - ceil(4n/5) + 1 shingles of
each.  The order puts rare shingles first, by a sketch of counts that only steers the cost.  Candidates are verified
on their whole sets.

In buckets of more than HOT members all are then compared with PIVOTS of them, which joins most of a large group
of near copies; after that only members of different components still have to be compared, and all of these are.

Texts stay where they are: rows are told apart by a 128-bit hash of all their columns, only those of candidates are
copied, and rows that go are taken out by that hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import discard, materialise, raw_text, small_batches, stored
from evloom.llm.graph import components
from evloom.llm.simhash import _links as simhash_links
from evloom.llm.simhash import majority

HOT = 16
#: Members of a hot bucket that all others are compared with first: of each PIVOTS-th of them, by a hash, the least.
PIVOTS = 16
#: Rows of two hashes up to which a table is broadcast (16 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of sets of shingles up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Keys before a key of a hot bucket that tell whether a pair is met at one of them already.
BACK = 16
#: Counters of the sketch and the blocks it is summed in.
SLOTS, BLOCKS = 1 << 22, 64
#: Words whose hash a worker remembers.
MEMORY = 300_000
MULTIPLY, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None, width: int = 5, memory: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words (ASCII lower case, cut at ASCII white space); a shorter text is one run."""
    memory = {} if memory is None else memory
    words = (text or b"").lower().split()
    if len(memory) > MEMORY:
        memory.clear()
    for w in set(words):
        if w not in memory:
            memory[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * MULTIPLY + h[k : k + n]
    return np.unique((out ^ (out >> np.uint64(29))) * MIX)


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of 4/5 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _levels(docs: DataFrame, width: int) -> np.ndarray:
    """For each slot of a shingle's hash a level that grows with how many rows have such shingles."""

    def count(batches):
        sketch, memory = np.zeros(SLOTS, np.uint8), {}
        for b in batches:
            for t in b.column("text").to_pylist():
                at = (shingles(t, width, memory) % np.uint64(SLOTS)).astype(np.int64)
                sketch[at] = np.minimum(sketch[at], 254) + 1
        parts = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(sketch.reshape(BLOCKS, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict = {}
        for d in batches:
            for k, x in zip(d["block"], d["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64)
        yield pd.DataFrame([(k, np.minimum(8 * np.log2(1 + x), 255).astype(np.uint8).tobytes()) for k, x in sums.items()], columns=["block", "levels"])

    sketches = materialise(raw_text(docs).mapInArrow(count, "block int, counts binary"), "sketch")
    out = np.zeros((BLOCKS, SLOTS // BLOCKS), np.uint8)
    for k, x in sketches.repartition(BLOCKS, "block").mapInPandas(add, "block int, levels binary").collect():  # BLOCKS rows, 4 MB in all
        out[k] = np.frombuffer(x, np.uint8)
    return out.ravel()


def _mark(docs: DataFrame) -> DataFrame:
    """docs with h1 and h2, hashes of all its columns, and the columns themselves as `kept`. Hashing skips nulls, so where they stand is hashed too, and columns with parts are hashed as JSON."""
    row = F.struct(*docs.columns)
    parts = lambda kind: kind.startswith(("struct", "array", "map"))
    values = [F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"}) if parts(kind) else F.col(c) for c, kind in docs.dtypes]
    null = F.array(*(F.col(c).isNull() for c in docs.columns))
    return docs.select(F.xxhash64(null, *values).alias("h1"), F.xxhash64(F.lit("second"), null, *values).alias("h2"), row.alias("kept"))


def prefixes(docs: DataFrame, width: int) -> DataFrame:
    """h1, h2, doc_id, digest (of the whole set), n (its size), fp (its SimHash), keys (the prefix in order) for docs(h1, h2, doc_id, text)."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs, width))

    def run(batches):
        memory: dict = {}
        for b in batches:
            digests, sizes, prints, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                x = shingles(t, width, memory)
                n = len(x)
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                sizes.append(n)
                prints.append(majority(x))
                order = np.lexsort((x, levels.value[(x % np.uint64(SLOTS)).astype(np.int64)]))
                keys.append(x[order[: n - -(-4 * n // 5) + 1 if n else 0]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["h1", "h2", "doc_id", "digest", "n", "fp", "keys"])

    return raw_text(docs, "h1", "h2", "doc_id").mapInArrow(run, f"h1 long, h2 long, doc_id {dict(docs.dtypes)['doc_id']}, digest binary, n long, fp long, keys array<bigint>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b: nodes) whose similarity is high enough; nodes(node, h1, h2) name a row of docs(h1, h2, text) each."""
    used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "used")
    rows = docs.join(_small(used), ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])

    def cut(batches):
        memory: dict = {}
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("node"), pa.array([shingles(t, width, memory).tobytes() for t in x.column("text").to_pylist()], pa.binary())], names=["node", "t"])

    # Each row is cut into shingles once, however many pairs it is in.
    sets = materialise(raw_text(rows, "node").mapInArrow(cut, "node long, t binary"), "cut")
    small = (sets.agg(F.sum(F.length("t"))).first()[0] or 0) <= BROADCAST_BYTES
    side = lambda k: (F.broadcast if small else lambda x: x)(sets.select(F.col("node").alias(k), F.col("t").alias(f"t{k}")))
    small_batches(docs.sparkSession)

    def run(batches):
        for x in batches:
            ok = pa.array([near(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x.column("ta").to_pylist(), x.column("tb").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(ok), x.column("b").filter(ok)], names=["a", "b"])

    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "verified")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a < b: nodes) at two or fewer differing bits of fp: fingerprints are met by their least nodes, and those with the node's fingerprint by the least of them."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    side = lambda k: least.select(F.col("fp").alias(k), F.col("node").alias(f"n{k}"))
    apart = simhash_links(least.select("fp")).join(side("a"), "a").join(side("b"), "b").select("na", "nb")
    same = nodes.join(least.withColumnRenamed("node", "na"), "fp").where("node != na").select("na", F.col("node").alias("nb"))
    return materialise(apart.unionAll(same).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")), "by-simhash")


def near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """h1, h2, doc_id, row (a number of its own), component (least row reachable over links, itself included) for docs(h1, h2, doc_id, text); rows of equal sets are linked."""
    spark, before = docs.sparkSession, stored()
    sets = materialise(prefixes(docs, width).withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = sets.groupBy("digest").agg(F.min(F.struct("row", "h1", "h2", "n", "fp", "keys")).alias("x")).select("digest", "x.*")
    nodes = materialise(nodes.withColumnRenamed("row", "node"), "nodes")
    named = nodes.select("node", "h1", "h2")
    alike = _verified(_by_simhash(nodes.select("node", "fp")), named, docs, width)
    first = materialise(components(alike), "first")
    discard(spark, stored() - before, ("prints", "shared", "held", "by-simhash", "used", "cut", "edges", "least", "star"))
    entries = nodes.select("node", F.posexplode("keys").alias("at", "key"), F.col("n").cast("int").alias("n")).select("key", "node", F.expr("shiftleft(cast(n as bigint), 32) | at").alias("place"))
    # Keys are counted by 32 bits of them, so too many are held at most; exact members are counted among those held.
    short = F.hash("key")
    shared = materialise(entries.groupBy(short.alias("s")).agg(F.count("*").alias("c")).where("c > 1").select("s"), "shared")
    held = materialise(entries.withColumn("s", short).join(shared, "s").drop("s"), "held")
    discard(spark, stored() - before, ("sketch", "shared"))
    by = materialise(held.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "by")
    held = held.join(by, "key").select("key", "node", "members", F.expr("shiftright(place, 32)").alias("n"), F.expr("place & 4294967295L").alias("at"))
    few, many = held.where(F.col("members") <= HOT), held.where(F.col("members") > HOT)
    # Sizes, and what can still be shared after the places of the key, must allow the similarity.
    can = "5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n and 9 * least(x.n - x.at, y.n - y.at) >= 4 * (x.n + y.n)"
    pair = (F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    close = few.alias("x").join(few.alias("y"), "key").where(f"x.node < y.node and {can}").select(*pair)
    pivots = many.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(PIVOTS))).agg(F.min(F.struct("node", "n", "at")).alias("p")).select("key", "p.*")
    pivots = materialise(pivots, "pivots")
    star = many.alias("x").join(pivots.alias("y"), "key").where(f"x.node != y.node and {can}").select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    # What SimHash has joined needs no second look.
    side = lambda k: _small(first.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")))
    pairs = close.unionAll(star).distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    pairs = materialise(pairs.where("coalesce(la, a) != coalesce(lb, b)").select("a", "b"), "pairs")
    links = alike.unionAll(_verified(pairs, named, docs, width))
    labels = materialise(components(links), "labels")
    left = many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A bucket whose members are one component has nothing left to compare.
    apart = left.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p != q").select("key")
    # A pair is compared at the first key it shares; earlier ones are looked for among the BACK keys before.
    left = left.join(apart, "key").join(nodes.select("node", "keys"), "node")
    left = materialise(left.select("key", "node", "n", "at", "label", F.slice("keys", F.greatest(F.col("at") - BACK + 1, F.lit(1)).cast("int"), F.least("at", F.lit(BACK)).cast("int")).alias("back")), "left")
    earliest = "not arrays_overlap(x.back, y.back)"
    rest = materialise(left.alias("x").join(left.alias("y"), "key").where(f"x.node < y.node and x.label != y.label and {can} and {earliest}").select(*pair).distinct(), "rest")
    if not rest.isEmpty():
        labels = materialise(components(links.unionAll(_verified(rest, named, docs, width))), "labels")
    of = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component"))
    out = materialise(sets.select("h1", "h2", "doc_id", "row", "digest").join(of, "digest").drop("digest"), "found")
    before |= {p for p in stored() if "/found-" in p}
    discard(spark, stored() - before)
    return out


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last), then the first. Null and repeated ids do no harm; of wholly equal rows one stays."""
    marked = _mark(docs)
    found = near_copies(marked.select("h1", "h2", "kept.doc_id", "kept.text"), width)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias("row"), F.lit(True).alias("stays"))
    judged = found.join(best, "row", "left").groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.bool_or(F.coalesce("stays", F.lit(False))).alias("stays"))
    judged = materialise(judged.where("copies > 1 or not stays"), "judged")
    once = marked.join(_small(judged.select("h1", "h2")), ["h1", "h2"], "left_anti").select("kept")
    copies = marked.join(_small(judged.where("stays").select("h1", "h2")), ["h1", "h2"]).dropDuplicates(["h1", "h2"]).select("kept")
    return once.unionAll(copies).select("kept.*")
