"""Quality rules with adaptive thresholds (operator 2), DataFrame operations only.

Each measure of a document becomes an integer bucket of 1/512 relative width.  Counts of buckets for each language and
source are a quantile sketch: they add, so sketches of tasks merge into those of a group, and
those of sources into those of a language and of the whole.  A group's fences are its own quantiles: one from its
90th (robust while under a tenth of it is junk), and a wider one from its 95th where the level above bears that out.  A group
of few documents uses its language's, or the whole table's.  Documents are joined to their fences and kept where each measure lies within.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.llm.common import WORD, materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: Documents a group needs for fences of its own.
LEAST = 100
#: Spreads (median to quantile) beyond the 90th, and beyond the 95th percentile.
WIDE, WIDER = 3, 2
#: For each measure in thousandths: the least room above the quantile, for groups whose documents are all alike, and whether low values are fenced too.
ROOM = {"symbols": (20, False), "capitals": (20, False), "length": (250, True), "lines": (20, False), "stutter": (20, False)}
#: Quantiles taken from the sketch, in hundredths.
QUANTILES = (5, 10, 50, 90, 95)


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """kept (a struct of the keep columns, null without any), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, stutter (words equal to the one before), base_failed. A null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    kept = (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("kept")
    first = docs.select(kept, text.alias("_t")).select("*", F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    first = first.select(
        "kept",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("capitals"),
        F.expr("cast(size(filter(_w, (x, i) -> i > 0 and x = _w[i - 1])) as bigint)").alias("stutter"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_l"),
        # log2 of the word count, rounded up: the low bits that hold a window's index.
        F.expr("length(bin(size(_w)))").alias("_bits"),
    )
    first = first.withColumn("_h", F.expr(f"case when size(_w) >= {WINDOW} then transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) else cast(array() as array<bigint>) end"))
    first = first.withColumn(
        "_s", F.expr("case when size(_h) = size(array_distinct(_h)) then cast(array() as array<bigint>) else sort_array(transform(_h, (h, i) -> shiftleft(shiftrightunsigned(h, _bits), _bits) | i)) end")
    )
    same = lambda j: f"shiftright(x, _bits) = shiftright(coalesce(try_element_at(_s, {j}), ~x), _bits)"
    first = first.withColumn("_c", F.expr(f"transform(filter(_s, (x, i) -> {same('i + 2')} or (i > 0 and {same('greatest(i, 1)')})), x -> cast(x & (shiftleft(1L, _bits) - 1) as int))"))
    # Equal hashes only name candidates; the windows themselves, sorted, decide.
    first = first.withColumn("_e", F.expr(f"sort_array(transform(_c, i -> named_struct('s', concat_ws(' ', slice(_w, i + 1, {WINDOW})), 'i', i)))"))
    first = first.withColumn("_p", F.expr("sort_array(transform(filter(_e, (x, k) -> x.s = try_element_at(_e, k + 2).s or (k > 0 and x.s = try_element_at(_e, greatest(k, 1)).s)), x -> cast(x.i as bigint)))"))
    repeat = F.expr(f"aggregate(_p, named_struct('n', 0L, 'end', 0L), (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.end, p), 'end', p + {WINDOW}), a -> a.n)")
    first = first.select(
        "kept", "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeat.alias("n_repeat_words"), "capitals", "stutter", F.size("_l").cast("long").alias("n_lines")
    )
    return first.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _bucket(x: str) -> str:
    """A number with its bits after the first ten cleared; SQL of Spark and DuckDB."""
    return f"({x} >> greatest(length(bin({x})) - 10, 0)) << greatest(length(bin({x})) - 10, 0)"


def _buckets() -> dict:
    per = lambda a, b: F.expr(_bucket(f"(cast({a} as bigint) * 1000 div greatest({b}, 1))"))
    return {"symbols": per("n_symbols", "n_words"), "capitals": per("capitals", "word_chars"), "length": per("word_chars", "n_words"), "lines": per("n_dup_lines", "n_lines"), "stutter": per("stutter", "n_words")}


def fences(measured: DataFrame) -> DataFrame:
    """level (0 source, 1 language, 2 all), lang, source, low and high bucket of each measure, from the documents that pass the base rules.

    The upper fence is WIDE spreads above the 90th percentile, or WIDER above the 95th if that is higher and no
    higher than the same of the level above.  So a source that is odd as a whole keeps its documents, and one with over a
    twentieth of junk can't open its own fence.  The lower fence mirrors it.
    """
    names = list(ROOM)
    long = measured.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.col(f"_{k}").alias("v")) for k in names])).alias("x")).select("lang", "source", "x.m", "x.v")
    # The sketches, merged by adding counts.
    sketch = materialise(long.groupBy("lang", "source", "m", "v").agg(F.count("*").alias("n")), "sketch")
    levels = sketch.select(F.lit(0).alias("level"), "lang", "source", "m", "v", "n")
    levels = levels.unionAll(sketch.groupBy("lang", "m", "v").agg(F.sum("n").alias("n")).select(F.lit(1), "lang", F.lit(None).cast("string"), "m", "v", "n"))
    levels = levels.unionAll(sketch.groupBy("m", "v").agg(F.sum("n").alias("n")).select(F.lit(2), F.lit(None).cast("string"), F.lit(None).cast("string"), "m", "v", "n"))
    by = Window.partitionBy("level", "lang", "source", "m")
    levels = levels.select("*", F.sum("n").over(by.orderBy("v")).alias("upto"), F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    stats = levels.groupBy("level", "lang", "source", "m").agg(F.max("all").alias("docs"), *[F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("v"))).alias(f"q{q}") for q in QUANTILES])
    room = F.element_at(F.create_map(*[x for k, (r, _) in ROOM.items() for x in (F.lit(k), F.lit(r))]), F.col("m"))
    wide = {f"{side}{k}": F.expr(f"q{q} + {k} * (q{q} - q50)") + sign * room for side, sign, qs in (("hi", 1, (90, 95)), ("lo", -1, (10, 5))) for k, q in zip((WIDE, WIDER), qs, strict=True)}
    stats = stats.where(F.col("docs") >= LEAST).select("level", "lang", "source", "m", *[x.alias(k) for k, x in wide.items()])
    above = lambda n: stats.where(F.col("level") == n)
    outer = above(1).select(F.lit(0).alias("l"), F.col("lang").alias("g"), F.col("m").alias("k"), F.col(f"hi{WIDER}").alias("hi"), F.col(f"lo{WIDER}").alias("lo"))
    outer = outer.unionAll(above(2).select(F.lit(1), F.lit(None).cast("string"), "m", f"hi{WIDER}", f"lo{WIDER}"))
    on = (F.col("level") == F.col("l")) & (F.col("m") == F.col("k")) & F.when(F.col("l") == 0, F.col("lang")).eqNullSafe(F.col("g"))
    stats = stats.join(outer, on, "left").select(
        "level", "lang", "source", "m", F.expr(f"greatest(hi{WIDE}, least(hi{WIDER}, coalesce(hi, hi{WIDER})))").alias("hi"), F.expr(f"least(lo{WIDE}, greatest(lo{WIDER}, coalesce(lo, lo{WIDER})))").alias("lo")
    )
    return stats.groupBy("level", "lang", "source").agg(*[F.max(F.when(F.col("m") == k, F.struct("lo", "hi"))).alias(k) for k in names])


#: Groups up to which the fences are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns, the measures, base_failed and kept.

    Null lang or source are groups of their own.  Where neither source, language nor table has LEAST
    documents, only the base rules hold.  Repeated rows are judged alike; an empty table gives no rows.
    """
    judged = _judged(docs, keep)
    return judged.select(*[F.col("kept.keep")[k].alias(k) for k in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("ok").alias("kept"))


def _judged(docs: DataFrame, keep) -> DataFrame:
    """kept (struct of lang, source and keep, a struct of the keep columns), the measures, base_failed, ok."""
    bundled = docs.select("lang", "source", "text", (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("keep"))
    measured = measures(bundled, "lang", "source", "keep").withColumns({"lang": F.col("kept.lang"), "source": F.col("kept.source")})
    measured = materialise(measured.withColumns({f"_{k}": v for k, v in _buckets().items()}), "measured")
    found = materialise(fences(measured), "fences")
    hint = F.broadcast if found.count() <= BROADCAST_GROUPS else lambda x: x
    names = list(ROOM)
    level = lambda n: found.where(F.col("level") == n)
    a = level(0).select(F.col("lang").alias("l0"), F.col("source").alias("s0"), F.struct(*names).alias("f0"))
    b = level(1).select(F.col("lang").alias("l1"), F.struct(*names).alias("f1"))
    c = level(2).select(F.struct(*names).alias("f2"))
    out = measured.join(hint(a), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
    out = out.join(hint(b), F.col("lang").eqNullSafe(F.col("l1")), "left").join(F.broadcast(c), F.lit(True), "left")  # c has one row at most
    out = out.withColumn("_f", F.coalesce("f0", "f1", "f2"))
    inside = F.lit(True)
    for k, (_, low) in ROOM.items():
        inside &= F.col(f"_{k}") <= F.col(f"_f.{k}.hi")
        if low:
            inside &= F.col(f"_{k}") >= F.col(f"_f.{k}.lo")
    return out.withColumn("ok", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """docs that the rules keep. Each row is judged by itself, also where its doc_id is null or repeated; extra columns may have any names."""
    return _judged(docs, docs.columns).where("ok").select("kept.keep.*")


def sql() -> str:
    """DuckDB's version of judge(documents, doc_id)."""
    per = {"symbols": "n_symbols * 1000 // greatest(n_words, 1)", "capitals": "capitals * 1000 // greatest(word_chars, 1)", "length": "word_chars * 1000 // greatest(n_words, 1)", "lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "stutter": "stutter * 1000 // greatest(n_words, 1)"}
    long = " union all ".join(f"select lang, source, '{k}' as m, b_{k} as v from bucketed where not base_failed" for k in per)
    room = "case m " + " ".join(f"when '{k}' then {r}" for k, (r, _) in ROOM.items()) + " end"
    wide = ", ".join(f"q{q} + {k} * (q{q} - q50) {sign} {room} as {side}{k}" for side, sign, qs in (("hi", "+", (90, 95)), ("lo", "-", (10, 5))) for k, q in zip((WIDE, WIDER), qs, strict=True))
    quantiles = ", ".join(f"min(case when u * 100 >= a * {q} then v end) as q{q}" for q in QUANTILES)
    test = " and ".join([f"b_{k} <= f.{k}.hi" for k in per] + [f"b_{k} >= f.{k}.lo" for k, (_, low) in ROOM.items() if low])
    pick = ", ".join(f"max(case when m = '{k}' then struct_pack(lo := lo, hi := hi) end) as {k}" for k in per)
    pack = "struct_pack(" + ", ".join(f"{k} := {{0}}.{k}" for k in per) + ")"
    return f"""
with texts as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
split as (select *, regexp_extract_all(t, '{WORD}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from texts),
windows as (select r, i, array_to_string(w[i:i+7], ' ') as s from (select r, w, unnest(range(1, len(w) - 6)) as i from split where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, s) as n from windows) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
measured as (
  select s.r, doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as capitals, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::bigint as stutter, len(l)::bigint as n_lines
  from split s left join covered c on s.r = c.r
), bucketed as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {", ".join(f"{_bucket('(' + v + ')')} as b_{k}" for k, v in per.items())} from measured
), long as ({long}),
levels as (
  select 0 as level, lang, source, m, v, count(*) as n from long group by all
  union all select 1, lang, null, m, v, count(*) from long group by lang, m, v
  union all select 2, null, null, m, v, count(*) from long group by m, v
), upto as (
  select *, sum(n) over (partition by level, lang, source, m order by v) as u, sum(n) over (partition by level, lang, source, m) as a from levels
), stats as (
  select level, lang, source, m, max(a) as docs, {quantiles} from upto group by level, lang, source, m
), wide as (select level, lang, source, m, {wide} from stats where docs >= {LEAST}),
bounds as (
  select w.level, w.lang, w.source, w.m, greatest(w.hi{WIDE}, least(w.hi{WIDER}, coalesce(o.hi{WIDER}, w.hi{WIDER}))) as hi, least(w.lo{WIDE}, greatest(w.lo{WIDER}, coalesce(o.lo{WIDER}, w.lo{WIDER}))) as lo
  from wide w left join wide o on o.level = w.level + 1 and o.m = w.m and (o.level = 2 or o.lang is not distinct from w.lang)
),
fences as (select level, lang, source, {pick} from bounds group by level, lang, source),
joined as (
  select b.*, coalesce(case when x.level = 0 then {pack.format("x")} end, case when y.level = 1 then {pack.format("y")} end, case when z.level = 2 then {pack.format("z")} end) as f
  from bucketed b left join (select * from fences where level = 0) x on b.lang is not distinct from x.lang and b.source is not distinct from x.source
  left join (select * from fences where level = 1) y on b.lang is not distinct from y.lang left join (select * from fences where level = 2) z on true
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({test}, true) as kept from joined
"""
