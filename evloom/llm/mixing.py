"""Mixing sources to target weights along a time-varying curriculum (operator 1).

Each source has a schedule: its weight at training times 0 to 1, linear between knots.  The
integral of a schedule is the source's share.  A source's documents, in an order fixed by a hash of
their ids, form its supply of words, repeated as often as its target asks; the word demand up
to a time is the schedule's integral up to it, so inverting that integral gives each document
occurrence its time.  Sorting by time gives the training order.

DataFrame operations only.  Running sums go over two levels of hash buckets, so a source
that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.llm.common import WORD, materialise

#: Knots (time, weight) by the source's place in the order; they integrate to 5, 2 and 1, falling, peaking midway and rising.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (0.5, 2.5), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: No source is taken more often than this.
MOST = 3
#: More sources than this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text"):
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def integrals(knots) -> list[float]:
    """The schedule's integral up to each knot."""
    out = [0.0]
    for (t, w), (u, v) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (u - t) * (w + v) / 2)
    return out


def source_targets(sizes: DataFrame, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """key, source_size, place (which schedule), target, for sizes(key, source, size), any number of rows a source.

    Sources, by code point with null last, take the schedules in turn.  Shares of the total are capped at
    `most` times a source's size; what is over is shared again by weight until none is above.  That
    ends at one level: sorted by cap per weight, a first run of sources is capped and the rest get the
    level times their weight.  The windows here see one row for each source, in one task.
    """
    shares = F.array(*[F.lit(integrals(k)[-1]) for k in schedules])
    by = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by = by.withColumn("place", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(schedules))
    by = by.withColumn("weight", F.element_at(shares, (F.col("place") + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    first = Window.orderBy(F.col("cap") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.select(
        "*",
        F.coalesce(F.sum("cap").over(first), F.lit(0)).alias("caps"),
        F.coalesce(F.sum("weight").over(first), F.lit(0.0)).alias("weights"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weight_total"),
    )
    by = by.withColumn("capped", F.col("cap") * (F.col("weight_total") - F.col("weights")) <= F.col("weight") * (F.col("total") - F.col("caps")))
    over = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(over), F.lit(0))
    weights = F.col("weight_total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(over), F.lit(0.0))
    return by.select("key", "source_size", "place", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (left / F.nullif(weights, F.lit(0.0)))).alias("target"))


def _time(share: str, knots) -> str:
    """SQL for the time at which a schedule has met a share (0 to 1) of its integral."""
    sums = integrals(knots)
    whole = sums[-1]
    cases = []
    for k in range(len(knots) - 1):
        (t, w), (u, v) = knots[k], knots[k + 1]
        w, slope, start = w / whole, (v - w) / whole / (u - t), sums[k] / whole
        rest = f"({share} - {start!r}D)"
        cases.append(f"when {share} <= {sums[k + 1] / whole!r}D or {k == len(knots) - 2} then {t!r}D + 2D * {rest} / ({w!r}D + sqrt({w * w!r}D + {2 * slope!r}D * {rest}))")
    return "case " + " ".join(cases) + " end"


def assign(docs: DataFrame, schedules=SCHEDULES, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, times (array, one for each repeat), position (the first time); with keep, also kept, a struct of those columns.

    A null text has size 0; documents without words are never over their source's need and stay once for each
    full pass.  A null source is a source of its own.  The order is by a hash of the id, or of the text where the id is null;
    equal ones order by id, size and the kept columns' hash, so that reruns agree, and rows that are wholly equal are as good as each other.
    The last pass takes the documents whose middle lies within what the target still needs, so
    the words taken come within one document of it.  An empty table gives no rows.
    """
    kept = F.struct(*keep) if keep else F.lit(None).cast("string")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.select(kept.alias("kept"), "doc_id", "source", word_count().alias("size"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), h.alias("h"))
    sized = sized.select("*", F.substring("h", 1, 2).alias("b1"), F.substring("h", 3, 3).alias("b2"))
    if not keep:
        sized = materialise(sized, "sized")
    # Sums of words for each of up to 16^5 runs of a source's order; whole texts are read again rather than stored.
    fine = materialise(sized.groupBy("key", "b1", "b2").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "runs")
    targets = materialise(source_targets(fine, schedules, most), "targets")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("key", "b1").agg(F.sum("size").alias("n")).select("key", "b1", F.coalesce(F.sum("n").over(before("key").orderBy("b1")), F.lit(0)).alias("base"))
    within = fine.select("key", "b1", "b2", F.coalesce(F.sum("size").over(before("key", "b1").orderBy("b2")), F.lit(0)).alias("within"))
    edges = within.join(coarse, ["key", "b1"]).select("key", "b1", "b2", (F.col("base") + F.col("within")).alias("edge"))
    ties = ["h", F.asc_nulls_first("doc_id"), "size", *([F.xxhash64("kept")] if keep else [])]
    placed = sized.withColumn("own", F.coalesce(F.sum("size").over(before("key", "b1", "b2").orderBy(*ties)), F.lit(0)))
    placed = placed.join(edges, ["key", "b1", "b2"]).withColumn("before", F.col("edge") + F.col("own"))
    small = targets.count() <= BROADCAST_SOURCES
    placed = placed.join(F.broadcast(targets) if small else targets, "key")
    full = "cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint)"
    placed = placed.withColumn("full", F.expr(full)).withColumn("extra", F.expr("2 * before + size <= 2 * (target - full * source_size) and source_size > 0 and full < " + str(most)))
    placed = placed.withColumn("repeats", (F.col("full") + F.col("extra").cast("int")).cast("long"))
    share = "least((cast(pass * source_size + before as double) / target), 1D)"
    time = "case place " + " ".join(f"when {k} then {_time(share, s)}" for k, s in enumerate(schedules)) + " end"
    times = F.expr(f"case when repeats > 0 and target > 0 then transform(sequence(0L, repeats - 1), pass -> {time}) else cast(array() as array<double>) end")
    return placed.select("kept", "doc_id", "source", "size", "source_size", "target", "repeats", times.alias("times")).withColumn("position", F.try_element_at("times", F.lit(1)))


def mix(docs: DataFrame, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """The mixed training set: docs' columns, a row for each occurrence, sorted by time over range partitions.

    Each row has repeats of its own, also where its doc_id is null or repeated.  Texts are shuffled
    twice, once to their place in the supply and once to their time.
    """
    plan = assign(docs, schedules, most, docs.columns).select("kept", F.explode("times").alias("time"))
    return plan.repartitionByRange("time").sortWithinPartitions("time", F.xxhash64("kept")).select("kept.*")


def mixing_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words with repeats), position, in the order of position."""
    plan = assign(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), F.round("position", 6).alias("position"))
    return plan.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def _times_sql(share: str, knots) -> str:
    return _time(share, knots).replace("D", "").replace("True", "true").replace("False", "false")


SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, md5(coalesce(doc_id::varchar, md5(coalesce(text, '')))) as h from documents
), by_source as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as place from sized group by source
), weighed as (
  select *, case place when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 3 * source_size as cap from by_source
), sums as (
  select *, coalesce(sum(cap) over w, 0) as caps, coalesce(sum(weight) over w, 0) as weights, sum(source_size) over () as total, sum(weight) over () as weight_total
  from weighed window w as (order by cap / weight, source rows between unbounded preceding and 1 preceding)
), flagged as (
  select *, cap * (weight_total - weights) <= weight * (total - caps) as capped from sums
), targets as (
  select source, source_size, place, case when capped then cap::double else weight * ((total - coalesce(sum(case when capped then cap end) over (), 0))::double / (weight_total - coalesce(sum(case when capped then weight end) over (), 0))) end as target from flagged
), placed as (
  select doc_id, size, source_size, place, target, coalesce(sum(size) over (partition by s.source order by h, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join targets t on s.source is not distinct from t.source
), passes as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as full_passes from placed
), repeated as (
  select *, full_passes + case when 2 * before + size <= 2 * (target - full_passes * source_size) and source_size > 0 and full_passes < 3 then 1 else 0 end as repeats, least(before::double / target, 1) as share from passes
)
select doc_id, size, source_size, target, (size * repeats)::bigint as taken,
  case when repeats > 0 and target > 0 then round(case place when 0 then {_times_sql("share", SCHEDULES[0])} when 1 then {_times_sql("share", SCHEDULES[1])} else {_times_sql("share", SCHEDULES[2])} end, 6) end as position
from repeated
"""
