"""How stable a search is: overlap of a family's query variants at five stages and three depths, and the confidence that follows.

All stages stand in one index of (candidate, family, query, entries of stage, item and rank), shuffled by family once.  Two variants have an item in common
at depth k if the larger of its two ranks is below k, so meeting by item gives the common counts of all depths, and pairs without a common item are never
made: they are counted, and medians are taken over the others' values with those zeros in front.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evloom import functions as fn

DEPTHS = (5, 10, 20)
STAGES = ("raw", "canonical", "post_filter", "final", "high_value")
#: Families that count as full coverage, and what separates high, medium and low confidence and an unstable family.
FULL, HIGH, MEDIUM, COVERED, HALF_COVERED, FLOOR = 5, 0.6, 0.4, 0.8, 0.6, 0.3


def _place(order: str, where: str = "true") -> str:
    """SQL: the place, from 0, of a row among its query's rows that fulfil a condition."""
    return f"sum(cast({where} as int)) over (partition by query_id order by {order} rows between unbounded preceding and current row) - 1"


def _first(item: str, order: str) -> str:
    """SQL: whether a row is the first of its query with its item."""
    return f"row_number() over (partition by query_id, {item} order by {order}) = 1"


def _stage(stage: str, item: str, first: str, rank: str):
    """A stage's entry of a row, null beyond the deepest place and for repeats."""
    return F.expr(f"case when {first} and {rank} < {max(DEPTHS)} then struct({STAGES.index(stage)} as stage, {item} as item, cast({rank} as int) as rank) end")


def search_index(queries: DataFrame, raw: DataFrame, kept: DataFrame, scores: DataFrame) -> DataFrame:
    """candidate, family, query_id, entries: for each row that has any, its entries (stage, item, rank) in the first 20 places of the stages, an item at its first place.

    queries: candidate, family, query_id (null candidates and families are left out).  raw: query_id, raw_rank, row_id, external_id, title, canonical_id.
    kept: query_id, rank, paper_id.  scores: candidate, paper_id, final_score, priority.  A paper without a score counts 0.
    """
    q = queries.where("candidate is not null and family is not null").select("candidate", "family", "query_id")
    scored = kept.join(q, "query_id").join(scores.select("candidate", "paper_id", "final_score", "priority"), ["candidate", "paper_id"], "left")
    text = lambda c: fn.blank_to_null(F.col(c).cast("string"))
    hashed = F.when(text("title").isNotNull(), F.concat(F.lit("hash:"), fn.title_hash("title")))
    external = F.concat(F.lit("ext:"), text("external_id"))
    row = F.concat(F.lit("row:"), F.col("row_id").cast("string"))
    canonical = F.coalesce(hashed, F.concat(F.lit("paper:"), text("canonical_id")), external, row)
    by = "raw_rank, row_id"
    found = raw.join(q, "query_id").select("candidate", "family", "query_id", "raw_rank", "row_id", F.coalesce(external, hashed, row).alias("item"), canonical.alias("key"))
    found = found.selectExpr("*", f"{_place(by)} as p", f"{_first('item', by)} as one", f"{_first('key', by)} as own")
    # Canonical places count distinct items, so repeats go before places are given.
    found = found.selectExpr("*", f"{_place(by, 'own')} as c").where(f"p < {max(DEPTHS)} or c < {max(DEPTHS)}")
    found = found.select("candidate", "family", "query_id", F.array_compact(F.array(_stage("raw", "item", "one", "p"), _stage("canonical", "key", "own", "c"))).alias("entries"))
    by, best = "rank, paper_id", "s, rank, paper_id"
    left = scored.select("candidate", "family", "query_id", "rank", "paper_id", F.col("paper_id").cast("string").alias("item"), (-F.coalesce("final_score", F.lit(0.0))).alias("s"), F.expr("coalesce(priority = 'high', false)").alias("high"))
    left = left.selectExpr("*", f"{_place(by)} as p", f"{_place(by, 'high')} as h", f"{_place(best)} as f", f"{_first('paper_id', by)} as one", f"{_first('paper_id', best)} as own", f"row_number() over (partition by query_id, paper_id, high order by {by}) = 1 and high as top")
    left = left.select("candidate", "family", "query_id", F.array_compact(F.array(_stage("post_filter", "item", "one", "p"), _stage("final", "item", "own", "f"), _stage("high_value", "item", "top", "h"))).alias("entries"))
    return found.unionByName(left).where("size(entries) > 0")


def at_stage(index: DataFrame, stage: str) -> DataFrame:
    """An index with the entries of one stage, for a waterfall of which the others are not asked for."""
    return index.withColumn("entries", F.filter("entries", lambda x: x["stage"] == STAGES.index(stage))).where("size(entries) > 0")


def _family(variants: list) -> list[dict]:
    """at (stage x 100 + k), jaccard, overlap of a family, given as a list of entries (stage, item, rank) for each variant.

    Only pairs that have an item in common are made; the others are counted."""
    stages = {}
    for q, entries in enumerate(variants):
        for stage, item, rank in entries:
            sizes, where = stages.setdefault(stage, ({}, {}))
            mine = sizes.setdefault(q, [0] * len(DEPTHS))
            for i, k in enumerate(DEPTHS):
                mine[i] += rank < k
            if item is not None:
                where.setdefault(item, []).append((q, rank))
    out = []
    for stage, (sizes, where) in stages.items():
        if len(sizes) < 2:
            continue
        met = {}
        for l in where.values():
            for (x, r), (y, t) in itertools.combinations(l, 2):
                common = met.setdefault((x, y), [0] * len(DEPTHS))
                for i, k in enumerate(DEPTHS):
                    common[i] += max(r, t) < k
        for i, k in enumerate(DEPTHS):
            n = sum(s[i] > 0 for s in sizes.values())
            if n > 1:
                pairs = [(b[i], sizes[x][i], sizes[y][i]) for (x, y), b in met.items() if b[i]]
                total = n * (n - 1) // 2
                middle = lambda v: sum(0.0 if at < total - len(v) else v[at - total + len(v)] for at in ((total - 1) // 2, total // 2)) / 2  # noqa: B023, E731
                out.append({"at": 100 * stage + k, "jaccard": middle(sorted(b / (x + y - b) for b, x, y in pairs)), "overlap": middle(sorted(b / min(x, y) for b, x, y in pairs))})
    return out


def _families(batches):
    """candidate, family, m: medians of each family of rows (candidate, family, query_id, entries) that are sorted by family; one family is held at a time."""
    now, variants, types = None, {}, None
    done = []

    def rows():
        keys, medians = zip(*done, strict=True)
        made = pa.array(medians, pa.list_(pa.struct([("at", pa.int32()), ("jaccard", pa.float64()), ("overlap", pa.float64())])))
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*keys, strict=True), types, strict=True)), made], ["candidate", "family", "m"])

    def end():
        if len(variants) > 1 and (m := _family(list(variants.values()))):
            done.append((now, m))

    for batch in batches:
        types = [batch.column(c).type for c in ("candidate", "family")]
        lists = batch.column("entries")
        x, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
        entries = list(zip(*(x.field(c).to_pylist() for c in ("stage", "item", "rank")), strict=True))
        begin = 0
        for key, q, to in zip(zip(*(batch.column(c).to_pylist() for c in ("candidate", "family")), strict=True), batch.column("query_id").to_pylist(), ends, strict=True):
            if key != now:
                end()
                now, variants = key, {}
            variants.setdefault(q, []).extend(entries[begin:to])
            begin = to
        if done:
            yield rows()
            done = []
    end()
    if done:
        yield rows()


def waterfall(queries: DataFrame, index: DataFrame) -> DataFrame:
    """candidate, family, stage, k, queries, jaccard, overlap: medians over pairs of a family's variants that have items at that stage.

    Every family has a row for each stage and depth; the medians are null where fewer than two variants have items.  The index is shuffled and sorted by family once, and gone through a family at a time.
    """
    lists = index.select("candidate", "family", "query_id", "entries").repartition("candidate", "family").sortWithinPartitions("candidate", "family")
    m = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("jaccard", T.DoubleType()), T.StructField("overlap", T.DoubleType())]))
    medians = lists.mapInArrow(_families, T.StructType([index.schema["candidate"], index.schema["family"], T.StructField("m", m)]))
    return _grid(queries, medians).select("candidate", "family", "stage", "k", "queries", "jaccard", "overlap")


def _grid(queries: DataFrame, medians: DataFrame) -> DataFrame:
    """A row for each family, stage and depth, with the medians there are; families meet them once, not once a row."""
    families = queries.where("candidate is not null and family is not null").groupBy("candidate", "family").agg(F.countDistinct("query_id").alias("queries"))
    lists = medians.select("candidate", "family", F.expr("map_from_entries(transform(m, x -> struct(x.at, struct(x.jaccard, x.overlap))))").alias("at"))
    grid = F.expr("array(" + ", ".join(f"struct('{name}' as stage, {k} as k, at[{100 * i + k}] as m)" for i, name in enumerate(STAGES) for k in DEPTHS) + ")")
    return families.join(lists, ["candidate", "family"], "left").select("candidate", "family", "queries", F.explode(grid).alias("x")).select("candidate", "family", "queries", "x.stage", "x.k", "x.m.jaccard", "x.m.overlap")


def rounds(comparisons: DataFrame, audits: DataFrame) -> DataFrame:
    """candidate, cross_round: share of the first five neighbours now that were also among the first five of the admitted audit before the last.

    comparisons: candidate, place, paper_id.  audits: candidate, created, admission, neighbours (array).  Null without two admitted audits, or where either side is empty.
    """
    now = comparisons.selectExpr("candidate", "paper_id", "row_number() over (partition by candidate order by place, paper_id) as n").where("n <= 5").groupBy("candidate").agg(F.collect_set("paper_id").alias("now"))
    before = audits.where("admission = 'PASS'").selectExpr("candidate", "neighbours", "row_number() over (partition by candidate order by created desc) as n").where("n = 2")
    before = before.select("candidate", F.array_distinct(F.slice("neighbours", 1, 5)).alias("before"))
    share = F.size(F.array_intersect("now", "before")) / 5
    return now.join(before, "candidate").where("size(before) > 0").select("candidate", share.alias("cross_round"))


def diagnostics(falls: DataFrame, rounds: DataFrame, convergence: DataFrame) -> DataFrame:
    """A row for each candidate of a waterfall: family_coverage, at_5, at_10, at_20 (medians over families), unstable (families below the floor), cross_round, convergence, confidence.

    convergence: candidate, prefix, stability of the cumulated top list; the last prefix's counts.
    """
    post = falls.where("stage = 'post_filter'")
    base = post.groupBy("candidate").agg(
        F.least(F.lit(1.0), F.countDistinct("family") / FULL).alias("family_coverage"), *(F.median(F.when(F.col("k") == k, F.col("jaccard"))).alias(f"at_{k}") for k in DEPTHS),
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("k") == 5) & (F.col("jaccard") < FLOOR), F.col("family")))), ",").alias("unstable"),
    )
    last = convergence.groupBy("candidate").agg(F.max_by("stability", "prefix").alias("convergence"))
    d = base.join(rounds, "candidate", "left").join(last, "candidate", "left")
    stable = (F.col("cross_round") >= HIGH) & (F.col("convergence").isNull() | (F.col("convergence") >= HIGH)) & (F.col("family_coverage") >= COVERED)
    fair = (F.col("cross_round") >= MEDIUM) & (F.col("family_coverage") >= HALF_COVERED)
    return d.withColumn("confidence", F.when(F.col("cross_round").isNull(), "INSUFFICIENT_OBSERVATION").when(stable, "high").when(fair, "medium").otherwise("low"))
