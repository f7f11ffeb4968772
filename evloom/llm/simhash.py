"""SimHash near-duplicates by deletion-variant signatures (operator 7).

A 64-bit fingerprint is cut into two segments, fewer than the three that pigeonholes would need
for equal segments at two differing bits: one of the two segments then differs by at most one
bit.  Each fingerprint is indexed under its 2 x 32 segment variants with one bit wildcarded;
fingerprints that share a variant are joined and their distance is verified.  Where a variant
holds more than HOT fingerprints, its members are linked through variants of the whole
fingerprint with two wildcards: those that share one differ in two bits at most, so a group has
four members at most and the work stays in proportion to the members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import materialise, raw_text
from evloom.llm.graph import components

SEED = 42
HOT = 32
#: Byte value to eight counters of eight bits.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhash64(text: bytes | None, width: int = 3) -> int:
    """The fingerprint as a signed integer; zero where there is no word."""
    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n < 2:
        return int(np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8").view("<i8")[0])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=False)], "<u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes (unsigned 64-bit) as a signed integer: bits that are set in over half of them; zero without any."""
    n = len(h)
    counts = np.zeros(64, np.int64)
    spread = SPREAD[h.view(np.uint8).reshape(n, 8)]
    for at in range(0, n, 255):
        counts += spread[at : at + 255].sum(0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp of whole texts: ASCII lower case, words between ASCII white space, shingles of `width` words, repeats included."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([simhash64(t, width) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return raw_text(docs, "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _links(fps: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints fp at two or fewer differing bits (through hot groups: pairs that connect the same)."""
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(
        "fp", F.expr("(shiftrightunsigned(fp, (v div 32) * 32) & 4294967295L & ~shiftleft(1L, v % 32)) | shiftleft(cast(v as bigint), 32)").alias("key")
    )
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    held = materialise(keyed.join(shared, "key"), "held")
    few = held.where(F.col("members") <= HOT).select("key", "fp")
    near = few.alias("x").join(few.alias("y"), "key").where("x.fp < y.fp and bit_count(x.fp ^ y.fp) <= 2").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = held.where(F.col("members") > HOT).select("fp").distinct()
    two = spark.range(64 * 64).select((F.col("id") / 64).cast("int").alias("i"), (F.col("id") % 64).cast("int").alias("j")).where("i < j")
    masks = two.agg(F.sort_array(F.collect_list(F.expr("shiftleft(1L, i) | shiftleft(1L, j)"))).alias("masks"))
    wild = many.crossJoin(F.broadcast(masks)).select("fp", F.explode("masks").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.expr("~mask")).alias("rest"))
    linked = wild.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("set")).where("size(set) > 1").select("a", F.explode("set").alias("b")).where("a != b")
    return near.unionAll(linked).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links, itself included).

    Rows of one fingerprint are one node, however many copies there are.  Null doc_ids get the
    component of their fingerprint; where no member has an id, component_id is null.  Repeated
    rows stay; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, width), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = materialise(components(_links(nodes.select("fp"))), "labels")
    labelled = materialise(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    firsts = materialise(labelled.groupBy("label").agg(F.min("first").alias("component_id")), "firsts")
    of = materialise(labelled.join(firsts, "label").select("fp", "component_id"), "of")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
