"""Search diagnostics over ranked results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evloom.operators import diagnostics, ranking
from evloom.plans.base import RANKED_SQL, query, ranked, table
from evloom.plans.q_ranking import _PREFIX

#: Lines of orders as what a source returned, what stayed of it, and scores by candidate. The expressions are both Spark's and DuckDB's.
RAW = ["query_id", "rank as raw_rank", "query_id * 100 + rank as row_id", "case when item % 4 <> 0 then concat(source, item % 50) end as external_id", "case when item % 7 <> 0 then concat('title ', item % 30) end as title", "case when item % 14 = 0 then concat('p', item % 3) end as canonical_id"]
KEPT = ["query_id", "rank", "item % 40 as paper_id"]
SCORE = ["candidate", "item % 40 as paper_id", "max((item * 37 % 11) / 10.0D) as final_score", "case when candidate % 2 = item % 40 % 3 then 'high' else 'low' end as priority"]


def _index(spark, d):
    r = ranked(spark, d)
    queries = r.select("candidate", "family", "query_id").distinct()
    scores = r.selectExpr("candidate", "item", "item % 40 as paper").groupBy("candidate", "paper").agg(F.max((F.col("item") * 37 % 11) / 10).alias("final_score")).selectExpr("candidate", "paper as paper_id", "final_score", "case when candidate % 2 = paper % 3 then 'high' else 'low' end as priority")
    return queries, diagnostics.search_index(queries, r.selectExpr(*RAW), r.selectExpr(*KEPT).where("paper_id % 5 <> 0"), scores)


_INDEX = f"""{RANKED_SQL}, raw as (select candidate, family, {', '.join(RAW)} from ranked), kept as (select candidate, family, {', '.join(KEPT)} from ranked where item % 40 % 5 <> 0),
sc as (select candidate, item % 40 as paper_id, max((item * 37 % 11) / 10.0::double) as final_score, case when candidate % 2 = item % 40 % 3 then 'high' else 'low' end as priority from ranked group by candidate, item % 40),
ks as (select * from kept left join sc using (candidate, paper_id)),
ra as (select *, row_number() over (partition by query_id order by raw_rank, row_id) - 1 as r, coalesce('ext:' || external_id, 'hash:' || title, 'row:' || row_id) as item, coalesce('hash:' || title, 'paper:' || canonical_id, 'ext:' || external_id, 'row:' || row_id) as key from raw),
ca as (select candidate, family, query_id, key as item, row_number() over (partition by query_id order by min(raw_rank)) - 1 as r from ra group by candidate, family, query_id, key),
ix as (select candidate, family, query_id, 'raw' as stage, item, r from ra union all select candidate, family, query_id, 'canonical', item, r from ca
  union all select candidate, family, query_id, 'post_filter', paper_id::varchar, row_number() over (partition by query_id order by rank, paper_id) - 1 from kept
  union all select candidate, family, query_id, 'final', paper_id::varchar, row_number() over (partition by query_id order by coalesce(final_score, 0) desc, rank, paper_id) - 1 from ks
  union all select candidate, family, query_id, 'high_value', paper_id::varchar, row_number() over (partition by query_id order by rank, paper_id) - 1 from ks where priority = 'high'),
sets as (select candidate, family, query_id, stage, k, list_distinct(list(item)) as items from ix, (values (5), (10), (20)) d(k) where r < k group by all),
pr as (select x.candidate, x.family, x.stage, x.k, len(list_intersect(x.items, y.items)) as n, len(x.items) as a, len(y.items) as b from sets x join sets y on x.candidate = y.candidate and x.family = y.family and x.stage = y.stage and x.k = y.k and x.query_id < y.query_id),
md as (select candidate, family, stage, k, median(n / (a + b - n)) as jaccard, median(n / least(a, b)) as overlap from pr group by all),
fall as (select f.candidate, f.family, s.stage, d.k, f.queries, jaccard, overlap from (select candidate, family, count(distinct query_id) as queries from ranked group by all) f, (values ('raw'), ('canonical'), ('post_filter'), ('final'), ('high_value')) s(stage), (values (5), (10), (20)) d(k) left join md on md.candidate = f.candidate and md.family = f.family and md.stage = s.stage and md.k = d.k)"""


@query(f"with {_INDEX} select candidate, family, stage, k, queries, round(jaccard, 6) as jaccard, round(overlap, 6) as overlap from fall")
def DEC24_stage_waterfall(spark, d):
    return diagnostics.waterfall(*_index(spark, d)).withColumn("jaccard", F.round("jaccard", 6)).withColumn("overlap", F.round("overlap", 6))


_AUDITS = "select o_custkey as candidate, o_orderkey as created, case when o_orderkey % 4 = 0 then 'BLOCKED' else 'PASS' end as admission, {list} as neighbours from orders"
_NEIGH = ["o_orderkey % 3", "o_custkey % 4", "o_orderkey % 2", "3", "o_custkey % 2", "0"]


@query(f"""with {_INDEX}, au as ({_AUDITS.format(list='[' + ', '.join(_NEIGH) + ']')}), bf as (select candidate, list_distinct(neighbours[1:5]) as before from (select *, row_number() over (partition by candidate order by created desc) as n from au where admission = 'PASS') where n = 2),
nw as (select c_custkey as candidate, list_distinct([c_custkey % 3, 3, c_custkey % 5]) as now from customer), cr as (select candidate, len(list_intersect(now, before)) / 5 as cross_round from nw join bf using (candidate)),
cv as (select candidate, arg_max((stability,), prefix)[1] as convergence from ({_PREFIX}) group by 1),
ba as (select candidate, least(1, count(distinct family) / 5) as family_coverage, median(jaccard) filter (k = 5) as at_5, median(jaccard) filter (k = 10) as at_10, median(jaccard) filter (k = 20) as at_20, coalesce(string_agg(family, ',' order by family) filter (k = 5 and jaccard < 0.3), '') as unstable from fall where stage = 'post_filter' group by 1)
select candidate, family_coverage, round(at_5, 6) as at_5, round(at_10, 6) as at_10, round(at_20, 6) as at_20, unstable, cross_round, convergence,
  case when cross_round is null then 'INSUFFICIENT_OBSERVATION' when cross_round >= 0.6 and coalesce(convergence, 1) >= 0.6 and family_coverage >= 0.8 then 'high' when cross_round >= 0.4 and family_coverage >= 0.6 then 'medium' else 'low' end as confidence
from ba left join cr using (candidate) left join cv using (candidate)""")
def DEC23_search_diagnostics(spark, d):
    """Orders stand for a candidate's audits, the customer for what is compared now."""
    queries, index = _index(spark, d)
    now = table(spark, d, "customer").selectExpr("c_custkey as candidate", "posexplode(array(c_custkey % 3, 3, c_custkey % 5)) as (place, paper_id)")
    audits = table(spark, d, "orders").selectExpr("o_custkey as candidate", "o_orderkey as created", "case when o_orderkey % 4 = 0 then 'BLOCKED' else 'PASS' end as admission", f"array({', '.join(_NEIGH)}) as neighbours")
    r = ranked(spark, d).withColumn("q", F.dense_rank().over(Window.partitionBy("candidate").orderBy("query_id")))
    prefix = ranking.prefix_stability(r).withColumn("stability", F.round("stability", 6))
    out = diagnostics.diagnostics(diagnostics.waterfall(queries, diagnostics.at_stage(index, "post_filter")), diagnostics.rounds(now, audits), prefix)
    return out.select("candidate", "family_coverage", *(F.round(f"at_{k}", 6).alias(f"at_{k}") for k in diagnostics.DEPTHS), "unstable", "cross_round", "convergence", "confidence")
