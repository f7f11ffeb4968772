"""AGG, WIN, SRT and VEC queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evloom import functions as fn
from evloom.operators import ranking, text, vectors
from evloom.plans.base import LINKS_SQL, RANKED_SQL, SCORES_SQL, links, query, ranked, scores, table


@query("select event_type, count(*) as n from events group by all")
def AGG01_group_count(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select count(*) as total, count(*) filter (quality is not null) as scored, count(*) filter (quality = 1 and toxic = 0) as high from labels")
def AGG02_scalar_counts(spark, d):
    return table(spark, d, "labels").agg(F.count("*").alias("total"), F.count("quality").alias("scored"), F.count_if(F.expr("quality = 1 and toxic = 0")).alias("high"))


@query(f"with {LINKS_SQL} select question_id, count(distinct paper_id) as papers from links group by all")
def AGG03_count_distinct(spark, d):
    return links(spark, d).groupBy("question_id").agg(F.countDistinct("paper_id").alias("papers"))


_MULTI = "select question_id, count(*) filter (relevance >= 0.5 and relation_type in ('supports', 'partially_answers')) as supporting, count(*) filter (relevance >= 0.5 and relation_type = 'contradicts') as contradicting, count(*) filter (relevance < 0.5) as background, count(distinct paper_id) filter (relevance >= 0.5 and relation_type in ('supports', 'partially_answers')) as s_papers, count(distinct paper_id) filter (relevance >= 0.5 and relation_type = 'contradicts') as c_papers from links group by 1"


@query(f"with {LINKS_SQL} {_MULTI}")
def AGG04_conditional(spark, d):
    from evloom.operators.coverage import tallies

    return tallies(links(spark, d)).select("question_id", "supporting", "contradicting", "background", "s_papers", "c_papers")


@query(f"with {RANKED_SQL} select candidate, item, count(*) as hits, count(distinct family) as families, count(distinct source) as sources, min(rank) as best_rank from ranked group by all")
def AGG05_hits_per_item(spark, d):
    return ranked(spark, d).groupBy("candidate", "item").agg(F.count("*").alias("hits"), F.countDistinct(F.coalesce("family", F.lit(""))).alias("families"), F.countDistinct("source").alias("sources"), F.min("rank").alias("best_rank"))


@query(f"with {SCORES_SQL} select batch, round(avg(relevance), 6) as mean, round(stddev_pop(relevance), 6) as std, round(median(relevance), 6) as mid from scores group by all")
def AGG06_07_moments(spark, d):
    return scores(spark, d).groupBy("batch").agg(F.round(F.avg("relevance"), 6).alias("mean"), F.round(F.stddev_pop("relevance"), 6).alias("std"), F.round(F.median("relevance"), 6).alias("mid"))


_PCT = "list_sort(list(relevance))[round_even({0} * (count(*) - 1), 0)::int + 1]"


@query(f"with {SCORES_SQL}, b as (select batch, relevance, case {' '.join(f'when relevance >= {k / 10}::double and relevance < {(k + 1) / 10}::double then {k}' for k in range(10))} end as b from scores), c as (select batch, b, count(*) as c from b where b is not null group by all), h as (select batch, array_to_string(list(format('{{:.1f}}-{{:.1f}}:', b / 10, (b + 1) / 10) || c order by b), ',') as hist from c group by 1) select batch, count(*) as n, min(relevance) as lo, max(relevance) as hi, round(avg(relevance), 4) as mean, {_PCT.format('0.25::double')} as p25, {_PCT.format('0.5::double')} as p50, {_PCT.format('0.75::double')} as p75, {_PCT.format('0.9::double')} as p90, any_value(hist) as hist from scores join h using (batch) group by all")
def AGG08_10_summary(spark, d):
    return ranking.distribution(scores(spark, d), "batch", "relevance")


@query(f"with {SCORES_SQL}, b as (select batch, case {' '.join(f'when relevance >= {k / 10}::double and relevance < {(k + 1) / 10}::double then {k}' for k in range(10))} end as bin from scores) select batch, bin, count(*) as n from b where bin is not null group by all")
def AGG09_histogram(spark, d):
    return scores(spark, d).withColumn("bin", fn.half_open_bin("relevance")).where("bin is not null").groupBy("batch", "bin").agg(F.count("*").alias("n"))


@query("with s as (select o_custkey as c, o_orderkey as q, list_distinct(list(l_partkey)) as items from orders join lineitem on l_orderkey = o_orderkey group by all), p as (select x.c, x.q as a, y.q as b, len(list_intersect(x.items, y.items)) as i, len(x.items) as m, len(y.items) as n from s x join s y on x.c = y.c and x.q < y.q) select a, b, round(i / (m + n - i), 6) as jaccard, round(i / least(m, n), 6) as overlap from p")
def AGG11_set_similarity(spark, d):
    s = ranked(spark, d).groupBy("candidate", "query_id").agg(F.collect_set("item").alias("items"))
    p = s.alias("x").join(s.alias("y"), "candidate").where("x.query_id < y.query_id").select(F.col("x.query_id").alias("a"), F.col("y.query_id").alias("b"), F.col("x.items").alias("i"), F.col("y.items").alias("j"))
    return p.select("a", "b", F.round(fn.jaccard("i", "j"), 6).alias("jaccard"), F.round(fn.overlap("i", "j"), 6).alias("overlap"))


@query("with r as (select *, row_number() over (partition by l_suppkey order by l_quantity desc, coalesce(l_discount + 0.0, 0) desc, l_partkey, l_orderkey) as n from lineitem) select l_suppkey as k, l_partkey as best from r where n = 1")
def AGG12_argmax_two_keys(spark, d):
    t = table(spark, d, "lineitem")
    key = F.struct(-F.col("l_quantity"), -F.coalesce(F.col("l_discount") + F.lit(0.0), F.lit(0.0)), "l_partkey", "l_orderkey")
    return t.groupBy(F.col("l_suppkey").alias("k")).agg(F.min_by("l_partkey", key).alias("best"))


@query("select user_id, arg_max(event_type, ts) as event_type, max(ts) as ts from events group by 1")
def AGG13_latest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"))


@query("select label, i, round(avg(x), 6) as mean from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by all")
def AGG14_vector_mean(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("select role, count(*) as n, sum(len(string_split(text, ' ')))::bigint as parts from conversations group by 1")
def AGG15_type_stats(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("parts"))


@query(f"with {LINKS_SQL} select question_id, round(count(*) filter (relevance >= 0.5) / greatest(count(*), 1), 6) as rate, case when count(*) = 0 then 0 else round(1 - count(distinct paper_id) / greatest(count(*), 1), 6) end as duplicate_rate from links group by 1")
def AGG16_ratios(spark, d):
    n = F.greatest(F.count("*"), F.lit(1))
    return links(spark, d).groupBy("question_id").agg(F.round(F.count_if(F.col("relevance") >= 0.5) / n, 6).alias("rate"), F.when(F.count("*") == 0, 0.0).otherwise(F.round(1 - F.countDistinct("paper_id") / n, 6)).alias("duplicate_rate"))


@query("select coalesce(max(l_linenumber) filter (l_quantity > 1000), 0) as none_over, coalesce(max(l_linenumber), 0) as most from lineitem")
def AGG17_max_default(spark, d):
    return table(spark, d, "lineitem").agg(F.coalesce(F.max(F.when(F.col("l_quantity") > 1000, F.col("l_linenumber"))), F.lit(0)).alias("none_over"), F.coalesce(F.max("l_linenumber"), F.lit(0)).alias("most"))


@query(f"with {LINKS_SQL} select evidence_id, array_to_string(list_sort(list(distinct question_id)), ',') as questions from links group by 1")
def AGG18_links_per_evidence(spark, d):
    return links(spark, d).groupBy("evidence_id").agg(F.array_join(F.array_sort(F.collect_set("question_id")).cast("array<string>"), ",").alias("questions"))


@query("select source, round(100 * avg(case when nullif(d.text, '') is null then 0 else 1 end), 4) as text, round(100 * avg(case when quality is null then 0 else 1 end), 4) as quality from documents d left join labels l on d.doc_id = l.doc_id group by 1")
def AGG19_completeness(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return t.groupBy("source").agg(F.round(100 * F.avg(F.when(fn.blank_to_null("text").isNull(), 0).otherwise(1)), 4).alias("text"), F.round(100 * F.avg(F.when(F.col("quality").isNull(), 0).otherwise(1)), 4).alias("quality"))


@query("select trim(lower(text)) as title, count(distinct source) as sources from documents group by 1 having count(distinct source) > 1")
def AGG20_cross_source(spark, d):
    return table(spark, d, "documents").groupBy(F.trim(F.lower("text")).alias("title")).agg(F.countDistinct("source").alias("sources")).where("sources > 1")


@query(f"with {LINKS_SQL}, m as (select question_id, max(round) as r from links group by 1), l as (select l.question_id, avg(relevance) as x from links l join m on l.question_id = m.question_id and l.round = m.r group by 1) select count(*) as questions, round(avg(x), 6) as mean from l")
def AGG21_latest_average(spark, d):
    by = links(spark, d).groupBy("question_id", "round").agg(F.avg("relevance").alias("x")).groupBy("question_id").agg(F.max_by("x", "round").alias("x"))
    return by.agg(F.count("*").alias("questions"), F.round(F.avg("x"), 6).alias("mean"))


# Windows -------------------------------------------------------------------------------------


@query(f"with {RANKED_SQL} select query_id, rank, item, row_number() over (partition by query_id, source order by rank) - 1 as raw_rank from ranked")
def WIN01_02_ranks(spark, d):
    return ranked(spark, d).withColumn("raw_rank", ranking.ordinal(["query_id", "source"], "rank")).select("query_id", "rank", "item", "raw_rank")


_CAL = "case when count(*) over w < 5 or stddev_pop(s) over w = 0 then s else least(greatest(s + 0.15::double * (s - avg(s) over w), 0), 1) end"


@query(f"with {SCORES_SQL}, x as (select paper_id, batch, 0.25::double * relevance + 0.3::double * authority + 0.15::double * recency + 0.15::double * novelty + 0.15::double * idea_potential as s from scores), c as (select paper_id, s, {_CAL} as c from x window w as (partition by batch)) select paper_id, round(s, 6) as score, round(c, 6) as calibrated, case when c >= 0.75 then 'high' when c >= 0.5 then 'medium' else 'low' end as tier from c")
def DEC03_04_WIN03_calibrated_tier(spark, d):
    s = scores(spark, d).withColumn("score", fn.weighted_score())
    return ranking.calibrate(s, "score", "batch").select("paper_id", F.round("score", 6).alias("score"), F.round("calibrated", 6).alias("calibrated"), fn.tier("calibrated").alias("tier"))


_LIST = f"with {LINKS_SQL}, one as (select *, row_number() over (partition by question_id, paper_id order by relevance desc, evidence_id, round, quantity, confidence) as i from links), two as (select *, row_number() over (partition by question_id order by relevance desc, evidence_id, round, quantity, confidence, paper_id) as depth from one where i <= 2), short as (select * from two where depth <= 8)"


def _short(spark, d):
    order = (F.desc("relevance"), "evidence_id", "round", "quantity", "confidence", "paper_id")
    return ranking.capped_shortlist(links(spark, d), "question_id", "paper_id", 2, 8, *order)


@query(_LIST + " select question_id, paper_id, evidence_id, depth from short")
def WIN04_capped_shortlist(spark, d):
    return _short(spark, d).select("question_id", "paper_id", "evidence_id", "depth")


@query(_LIST + ", f as (select evidence_id, min(depth * 1000000000 + question_id) as t from short group by 1) select evidence_id, t // 1000000000 as depth, t % 1000000000 as question_id from f order by t, evidence_id limit 40")
def WIN05_round_robin(spark, d):
    return ranking.round_robin(_short(spark, d), "question_id", "evidence_id", 40)


_CHUNKS = "chunks as (select conv_id as item_id, role as section, case role when 'user' then 1 when 'assistant' then 2 else 3 end as priority, turn as pos from conversations)"


@query(f"with {_CHUNKS}, t as (select *, row_number() over (partition by item_id, section order by pos) as depth, min(pos) over (partition by item_id, section) as fp from chunks), p as (select *, row_number() over (partition by item_id order by depth, priority, fp, pos) as place from t) select item_id, pos, place from p where place <= 6")
def WIN06_section_interleave(spark, d):
    t = table(spark, d, "conversations").selectExpr("conv_id as item_id", "role as section", "case role when 'user' then 1 when 'assistant' then 2 else 3 end as priority", "turn as pos")
    return ranking.interleave_sections(t, 6).select("item_id", "pos", "place")


@query(f"with {RANKED_SQL} select query_id, array_to_string(list_sort(list(distinct item)), ',') as items from ranked where rank < 5 group by 1")
def WIN07_topk_sets(spark, d):
    return ranking.top_sets(ranked(spark, d), ["query_id"], "item", 5, "rank").select("query_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


_PREFIX = f"""with {RANKED_SQL}, qs as (select *, dense_rank() over (partition by candidate order by query_id) as q from ranked), wide as (select candidate, p.prefix, item, count(distinct q) as hits, count(distinct family) as families, min(rank) as best, count(distinct source) as sources from qs join (select candidate as c, q as prefix from qs group by all) p on p.c = candidate and q <= p.prefix group by candidate, p.prefix, item),
top as (select *, row_number() over (partition by candidate, prefix order by 0.4::double * hits + 0.3::double * families + 0.2::double / (best + 1) + 0.1::double * sources desc, item) as n from wide), sets as (select candidate, prefix, list_sort(list(item)) as items from top where n <= 5 group by all), l as (select *, lag(items) over (partition by candidate order by prefix) as before from sets)
select candidate, prefix, case when before is not null then round(len(list_intersect(items, before)) / len(list_distinct(list_concat(items, before))), 6) end as stability from l"""


@query(_PREFIX)
def WIN08_prefix_stability(spark, d):
    r = ranked(spark, d).withColumn("q", F.dense_rank().over(Window.partitionBy("candidate").orderBy("query_id")))
    return ranking.prefix_stability(r).select("candidate", "prefix", F.round("stability", 6).alias("stability"))


@query(f"with {LINKS_SQL}, r as (select question_id, round, count(distinct paper_id) as n from links group by all) select question_id, round, n - lag(n, 1, 0) over (partition by question_id order by round) as delta, sum(n) over (partition by question_id order by round)::bigint as upto from r")
def WIN09_10_delta_cumulative(spark, d):
    r = links(spark, d).groupBy("question_id", "round").agg(F.countDistinct("paper_id").alias("n"))
    w = Window.partitionBy("question_id").orderBy("round")
    return r.select("question_id", "round", (F.col("n") - F.lag("n", 1, 0).over(w)).alias("delta"), F.sum("n").over(w).alias("upto"))


@query("with r as (select user_id, ts, event_id, (event_type = 'purchase')::int as r from events), g as (select *, sum(r) over (partition by user_id order by ts) as g from r) select event_id, sum(1 - r) over (partition by user_id, g order by ts rows between unbounded preceding and current row)::bigint as streak from g")
def WIN11_streak_reset(spark, d):
    return ranking.streak(table(spark, d, "events"), ["user_id"], "ts", F.col("event_type") == "purchase").select("event_id", "streak")


@query("with r as (select user_id, ts, event_id, coalesce(event_type <> lag(event_type) over (partition by user_id order by ts), true)::int as c from events), g as (select *, sum(c) over (partition by user_id order by ts) as g from r) select event_id, row_number() over (partition by user_id, g order by ts) as same from g")
def WIN12_identical_streak(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    t = table(spark, d, "events").withColumn("_c", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)))
    return ranking.streak(t, ["user_id"], "ts", F.col("_c")).select("event_id", (F.col("streak") + 1).alias("same"))


@query(f"with {RANKED_SQL}, h as (select *, row_number() over (partition by query_id order by rank desc) as n from ranked) select query_id, rank as version, item from h where n = 1")
def WIN13_version_heads(spark, d):
    return ranking.heads(ranked(spark, d), "query_id", "rank", "item").select("query_id", F.col("rank").alias("version"), "item")


@query("with u as (select conv_id, turn, length(text) as s, sum(length(text)) over (partition by conv_id order by turn) as u from conversations) select conv_id, turn, case when u <= 1500 then s else 1500 - (u - s) end::bigint as took from u where u <= 1500 or (u - s <= 1500 and 1500 - (u - s) > 200)")
def WIN14_15_budget_packing(spark, d):
    t = table(spark, d, "conversations").withColumn("s", F.length("text").cast("long"))
    return ranking.pack(t, ["conv_id"], ["turn"], "s", 1500).select("conv_id", "turn", "took")


def _named(table_of: dict, head: str, form: str) -> str:
    """SQL: the first section of a table of words whose form a heading has."""
    return "case " + " ".join(f"when regexp_matches({head}, '{form.format('|'.join(words))}') then '{name}'" for name, words in table_of.items()) + " end"


#: documents whose every ninth line is replaced by a heading in turn, and one line in thirteen marked, as lines.
HEADS = ("## 3. Method", "Results", "Related work and more", "Conclusion", "4 Setup", "plain line", "1. Abstract", "  Threats to validity ")
_TEXTS = "list_transform(string_split(text, chr(10)), lambda x, i: case when (i + doc_id) % 9 = 0 then [" + ", ".join(f"'{h}'" for h in HEADS) + "][((i // 9 + doc_id) % 8 + 1)::bigint] when (i + doc_id) % 13 = 0 then '[TABLE] ' || x || ' [/TABLE] [FIGURE: a b]' else x end)"
_HEADED = f"t as (select doc_id, {_TEXTS} as ls from documents), raw as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from t)"


def headed(spark, d):
    heads = "array(" + ", ".join(f"'{h}'" for h in HEADS) + ")"
    line = f"case when (i + 1 + doc_id) % 9 = 0 then element_at({heads}, cast(((i + 1) div 9 + doc_id) % 8 + 1 as int)) when (i + 1 + doc_id) % 13 = 0 then concat('[TABLE] ', x, ' [/TABLE] [FIGURE: a b]') else x end"
    return table(spark, d, "documents").selectExpr("doc_id", f"array_join(transform(split(text, '\n'), (x, i) -> {line}), '\n') as text")


_LOOSE = _named(text.SECTIONS, "h", "{}")
_CHUNKS = f"""with recursive {_HEADED},
heads as (select *, trim(regexp_replace(lower(trim(line)), '^#+', '')) as h from raw),
lines as (select doc_id, i, len(list_filter(regexp_split_to_array(regexp_replace(line, '{text.MARKS}', '', 'g'), '\\s+'), lambda w: w <> '')) as w, case when length(h) <= 80 then {_LOOSE} end as h, trim(line) <> '' as b from heads),
st as (select doc_id, (-1)::bigint as i, 'unknown' as sec, 0::bigint as n, false as live, null::bigint as pos0, null::varchar as o_sec, null::bigint as o_n, null::bigint as o_at from t
  union all select l.doc_id, l.i, coalesce(l.h, s.sec), case when l.h is not null or s.n + w >= 250 then 0 else s.n + w end, case when l.h is not null or s.n + w >= 250 then false else s.live or b end, case when l.h is not null or s.n + w >= 250 then null else coalesce(s.pos0, l.i) end,
  case when l.h is not null then case when s.live then s.sec end when s.n + w >= 250 then s.sec end, case when l.h is not null then s.n else s.n + w end, case when l.h is not null then s.pos0 else coalesce(s.pos0, l.i) end from st s join lines l on l.doc_id = s.doc_id and l.i = s.i + 1),
ends as (select doc_id, max(i) as i from st group by 1),
done as (select doc_id, o_sec as section, o_n as n_words, o_at as first_line from st where o_sec is not null union all select st.doc_id, sec, n, pos0 from st join ends on st.doc_id = ends.doc_id and st.i = ends.i where live)
select doc_id, row_number() over (partition by doc_id order by first_line) - 1 as chunk, section, n_words, first_line from done"""


@query(_CHUNKS)
def WIN16_reset_accumulation(spark, d):
    return text.accumulate_chunks(headed(spark, d), "doc_id", 250)


@query("select doc_id, i, substr(text, i * 4000 + 1, 4000) as part from (select doc_id, text, unnest(range(0, greatest(1, (length(text) + 3999) // 4000))) as i from documents)")
def WIN17_fixed_slices(spark, d):
    return text.slices(table(spark, d, "documents").select("doc_id", "text"), 4000).select("doc_id", "i", "part")


@query("select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 40 as batch, '[P' || row_number() over (partition by source order by n_chars desc, doc_id) || ']' as label from documents")
def WIN18_19_batches_labels(spark, d):
    t = table(spark, d, "documents")
    n = ranking.ordinal(["source"], "doc_id")
    return t.select("doc_id", F.floor(n / 40).alias("batch"), F.concat(F.lit("[P"), (ranking.ordinal(["source"], F.desc("n_chars"), "doc_id") + 1).cast("string"), F.lit("]")).alias("label"))


# Sorts ---------------------------------------------------------------------------------------


@query("select p_partkey, nullif(p_size % 7, 0) as score from part order by nullif(p_size % 7, 0) desc nulls last, p_partkey limit 50 offset 10")
def SRT01_nulls_last_page(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr("nullif(p_size % 7, 0)").alias("score")).orderBy(F.desc_nulls_last("score"), "p_partkey").offset(10).limit(50)


@query(f"with {RANKED_SQL}, n as (select *, row_number() over (partition by candidate order by nullif(rank, 3) desc nulls last, nullif(item % 10, 0) desc nulls last, query_id, item) as n from ranked) select candidate, query_id, item, n from n where n <= 5")
def SRT02_two_keys_top5(spark, d):
    n = ranking.ordinal(["candidate"], F.desc_nulls_last(F.nullif("rank", F.lit(3))), F.desc_nulls_last(F.nullif(F.col("item") % 10, F.lit(0))), "query_id", "item") + 1
    return ranked(spark, d).withColumn("n", n).where("n <= 5").select("candidate", "query_id", "item", "n")


_HEUR = "least(coalesce(citation_count, 0) / 50.0::double, 3) + coalesce(greatest(0, least((year - 2018) / 2.0::double, 3)), 0) + case when top_venue then 2 else 0 end + case when paper_id % 3 > 0 then 0.5::double else 0 end - case when paper_id % 10 = 0 then 2 else 0 end"


@query(f"with {SCORES_SQL}, h as (select paper_id, batch, {_HEUR} as h, row_number() over (partition by batch order by {_HEUR} desc, paper_id) as n from scores) select paper_id, round(h, 6) as heuristic, n <= 40 as scored, case when n > 40 then 0.3::double end as final_score, case when n > 40 then 'low' end as priority from h")
def SRT03_DEC01_heuristic_topn(spark, d):
    s = scores(spark, d).withColumn("h", fn.heuristic_score("citation_count", "year", "top_venue", F.expr("paper_id % 3 > 0"), F.expr("paper_id % 10 = 0")))
    s = s.withColumn("n", ranking.ordinal(["batch"], F.desc("h"), "paper_id") + 1)
    return s.select("paper_id", F.round("h", 6).alias("heuristic"), (F.col("n") <= 40).alias("scored"), F.when(F.col("n") > 40, 0.3).alias("final_score"), F.when(F.col("n") > 40, "low").alias("priority"))


_POOL = f"with {RANKED_SQL}, n as (select candidate, item, count(*) as hits, case when item % 4 = 0 then null else (item % 97) / 96.0::double end as rel from ranked group by all), a as (select *, row_number() over (partition by candidate order by coalesce(rel, -1) desc, hits desc, item) as n from n where rel is not null), b as (select *, row_number() over (partition by candidate order by hits desc, item) as n from n where rel is null), u as (select candidate, item, 0 as pool, n from a where n <= 20 union all select candidate, item, 1, n from b)"


@query(_POOL + ", r as (select *, row_number() over (partition by candidate order by pool, n) as place from u) select candidate, item, pool, place from r where place <= 5")
def SRT04_05_relevance_then_fill(spark, d):
    n = ranked(spark, d).groupBy("candidate", "item").agg(F.count("*").alias("hits")).withColumn("rel", F.expr("case when item % 4 = 0 then null else (item % 97) / 96.0D end"))
    a = n.where("rel is not null").withColumn("n", ranking.ordinal(["candidate"], F.desc(F.coalesce("rel", F.lit(-1.0))), F.desc("hits"), "item") + 1).where("n <= 20").select("candidate", "item", F.lit(0).alias("pool"), "n")
    b = n.where("rel is null").withColumn("n", ranking.ordinal(["candidate"], F.desc("hits"), "item") + 1).select("candidate", "item", F.lit(1).alias("pool"), "n")
    return a.unionByName(b).withColumn("place", ranking.ordinal(["candidate"], "pool", "n") + 1).where("place <= 5").select("candidate", "item", "pool", "place")


@query("select s_suppkey, (1 - (s_suppkey % 10) / 10.0::double) * ((s_suppkey % 7) / 6.0::double) * 0.5::double as value from suppliers_open order by value desc, s_suppkey limit 3".replace("suppliers_open", "(select * from supplier where s_acctbal > 0)"))
def SRT06_next_targets(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 0")
    return s.select("s_suppkey", F.expr("(1 - (s_suppkey % 10) / 10.0D) * ((s_suppkey % 7) / 6.0D) * 0.5D").alias("value")).orderBy(F.desc("value"), "s_suppkey").limit(3)


@query("with r as (select o_orderkey, row_number() over (order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_totalprice desc, o_orderkey) as n from orders) select o_orderkey, n from r where n <= 30")
def SRT08_10_mapped_priority(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    top = table(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(30)
    return top.withColumn("n", ranking.ordinal([], rank, F.desc("o_totalprice"), "o_orderkey") + 1).select("o_orderkey", "n")


@query("with r as (select p_partkey, row_number() over (partition by p_brand order by p_size > 25 desc, p_retailprice desc, p_partkey) as n from part) select p_partkey, n, (n - 1) // 5 as batch from r")
def SRT09_WIK07_high_first_batches(spark, d):
    n = ranking.ordinal(["p_brand"], F.desc(F.col("p_size") > 25), F.desc("p_retailprice"), "p_partkey") + 1
    return table(spark, d, "part").select("p_partkey", n.alias("n"), F.floor((n - 1) / 5).alias("batch"))


# Vectors -------------------------------------------------------------------------------------

_SIM = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)"


@query(f"select a.vec_id as a, b.vec_id as b, {_SIM} as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and b.label = a.label")
def VEC01_JON11_pairs(spark, d):
    e = table(spark, d, "embeddings")
    # Lengths are taken once a vector, not once a pair.
    side = lambda t, k: t.select(F.col("vec_id").alias(k), F.col("embedding").alias(f"v{k}"), F.sqrt(fn.dot("embedding", "embedding")).alias(f"n{k}"), "label")
    pairs = side(e.where("vec_id % 100 = 0"), "a").join(side(e, "b"), "label").where("a <> b")
    return pairs.select("a", "b", F.round(fn.cosine("va", "vb", F.col("na") * F.col("nb")), 6).alias("sim"))


@query(f"with s as (select a.vec_id as q, b.vec_id as id, {_SIM} as sim from embeddings a, embeddings b where a.vec_id % 100 = 0 and b.label in (1, 2, 3)), r as (select *, row_number() over (partition by q order by sim desc, id) as n from s) select q, id, sim from r where n <= 5 and sim >= 0.1")
def VEC03_FLT07_11_filtered_topk(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e.where("vec_id % 100 = 0"), e.where("label in (1, 2, 3)"), "vec_id", "embedding", 5).where("sim >= 0.1").select("q", "id", "sim")


@query(f"with s as (select a.vec_id as q, b.vec_id as id, {_SIM} as sim from embeddings a, embeddings b where a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by sim desc, id) as n from s) select q, id, sim from r where n <= 5 and sim >= 0.2")
def VEC04_nearest_items(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e, "vec_id", "embedding", 5, exclude_self=True).where("sim >= 0.2").select("q", "id", "sim")


@query("with m as (select label, i, avg(x) as x from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all), v as (select label, list(x order by i) as vec from m group by label) select label, round(list_cosine_similarity(vec, (select embedding::double[] from embeddings where vec_id = 0)), 6) as sim, list_cosine_similarity(vec, (select embedding::double[] from embeddings where vec_id = 0)) >= 0.7 as invariant from v")
def VEC05_06_item_vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = vectors.mean_vectors(e, "label", "embedding")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(one)).select("label", F.round(fn.cosine("vec", "q"), 6).alias("sim"), (fn.cosine("vec", "q") >= 0.7).alias("invariant"))


@query("with t as (select r_regionkey, r_name from region), n as (select n_nationkey, n_name from nation), s as (select n_nationkey, r_name, len(list_intersect(list_distinct(string_split(n_name, '')), list_distinct(string_split(r_name, '')))) / len(list_distinct(list_concat(string_split(n_name, ''), string_split(r_name, '')))) as j, r_regionkey from n, t), r as (select *, row_number() over (partition by n_nationkey order by j desc, r_regionkey) as k from s) select n_nationkey, case when j >= 0.5 then r_name end as match, round(j, 6) as score from r where k = 1")
def VEC07_character_jaccard(spark, d):
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    j = fn.jaccard(F.array_distinct(F.split("n_name", "")), F.array_distinct(F.split("r_name", "")))
    s = n.crossJoin(F.broadcast(r)).withColumn("j", j).groupBy("n_nationkey").agg(F.min_by(F.struct("r_name", "j"), F.struct(-F.col("j"), "r_regionkey")).alias("m"))
    return s.select("n_nationkey", F.when(F.col("m.j") >= 0.5, F.col("m.r_name")).alias("match"), F.round("m.j", 6).alias("score"))
