"""SRC, TXT, HSH, DEC, ST, GRF, WIK and RPT queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evloom import functions as fn
from evloom import sources, streaming
from evloom.operators import coverage, gates, graph, ranking, state, text, vectors
from evloom.plans.base import HITS_SQL, LINKS, LINKS_SQL, RANKED_SQL, SCORES_SQL, hits, links, query, ranked, scores, table
from evloom.plans.q_ranking import _HEADED, _MULTI, _named, headed

# Coverage and quality -------------------------------------------------------------------------

_COV = f"with {LINKS_SQL}, m as ({_MULTI}), n as (select *, supporting + contradicting + background as n from m), s as (select *, case when n >= 5 and s_papers >= 3 then least(1.0::double, 0.4::double + 0.1::double * s_papers + 0.05::double * c_papers) when n >= 3 and s_papers >= 1 then 0.3::double + 0.1::double * s_papers when n >= 1 then 0.15::double else 0 end as score from n)"


@query(_COV + ", q as (select s_suppkey as q from supplier union all select -1 - s_suppkey from supplier) select q as question_id, coalesce(supporting, 0) as supporting, coalesce(contradicting, 0) as contradicting, coalesce(background, 0) as background, coalesce(s_papers, 0) as s_papers, coalesce(c_papers, 0) as c_papers, round_even(coalesce(score, 0), 2)::double as coverage, case when score >= 0.7 then 'covered' when score >= 0.3 then 'partially_covered' else 'open' end as status, least(1.0::double, 0.15::double * coalesce(n, 0)) as confidence from q left join s on q = question_id")
def DEC05_coverage(spark, d):
    """Suppliers as questions, and as many more that nothing is linked to."""
    return coverage.matrix(links(spark, d), table(spark, d, "supplier").selectExpr("s_suppkey as question_id").unionAll(table(spark, d, "supplier").selectExpr("-1 - s_suppkey")))


_QTYPE = "case s_suppkey % 8 when 0 then 'problem' when 1 then 'method' when 2 then 'evaluation' when 3 then 'dataset' when 4 then 'resource' when 5 then 'failure' when 6 then 'application' else 'other' end"
_ETYPE = "case l_partkey % 10 when 0 then 'problem' when 1 then 'method' when 2 then 'result' when 3 then 'metric' when 4 then 'comparison' when 5 then 'dataset' when 6 then 'limitation' when 7 then 'negative_result' when 8 then 'future_work' else 'claim' end"
_ANSWERS = " or ".join(f"(t = '{q}' and e in ({', '.join(repr(x) for x in es)}))" for q, es in coverage.ANSWERS.items())


@query(f"with m as (select l_suppkey as q, {_ETYPE} as e, {_QTYPE} as t from lineitem join supplier on l_suppkey = s_suppkey) select q as question_id, case e when 'negative_result' then 'contradicts' when 'limitation' then 'partially_answers' when 'future_work' then 'background' when 'comparison' then 'background' else 'supports' end as relation, count(*) as links, sum(0.5::double) as relevance from m where {_ANSWERS} group by all")
def DEC07_heuristic_match(spark, d):
    q = table(spark, d, "supplier").selectExpr("s_suppkey as question_id", f"{_QTYPE} as question_type")
    e = table(spark, d, "lineitem").selectExpr("l_suppkey as question_id", "l_orderkey as evidence_id", f"{_ETYPE} as evidence_type")
    return coverage.heuristic_match(q, e).groupBy("question_id", "relation").agg(F.count("*").alias("links"), F.sum("relevance").alias("relevance"))


@query(f"with {LINKS_SQL}, s as (select * from links where relevance >= 0.5 and relation_type in ('supports', 'partially_answers')), b as (select question_id, avg(fulltext::int) as f, avg((relation_type = 'supports')::int) as d, count(distinct paper_id) as s, avg(confidence) as m from s group by 1) select q.question_id, coalesce(round_even(0.4::double * f + 0.25::double * d + 0.2::double * least(1, s / 3) + 0.15::double * m, 2), 0)::double as quality, coalesce(round_even(f, 2), 0)::double as fulltext_ratio, coalesce(round_even(d, 2), 0)::double as directness from (select distinct question_id from links) q left join b on q.question_id = b.question_id")
def DEC08_evidence_quality(spark, d):
    return coverage.quality(links(spark, d))


_SAT = f"""with {LINKS_SQL}, sup as (select * from links where relevance >= 0.5 and relation_type in ('supports', 'partially_answers')),
papers as (select question_id, paper_id, min(round) as r, case paper_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as priority, (paper_id % 101) / 100.0::double as score from sup group by question_id, paper_id),
ev as (select l.question_id, l.paper_id, l.round as r from links l join papers p on l.question_id = p.question_id and l.paper_id = p.paper_id),
rounds as (select question_id, unnest(range(1, max(round)::bigint + 1))::int as round from links group by 1),
c as (select *, (select count(*) from papers p where p.question_id = x.question_id and priority <> 'low' and p.r = x.round) as new_papers, (select count(*) from papers p where p.question_id = x.question_id and priority <> 'low' and p.r <= x.round) as papers,
  (select count(distinct paper_id) from ev where ev.question_id = x.question_id and ev.r = x.round) as new_evidence, (select count(distinct paper_id) from ev where ev.question_id = x.question_id and ev.r <= x.round) as evidence from rounds x),
k as (select x.question_id, x.round, paper_id, row_number() over (partition by x.question_id, x.round order by score desc, paper_id) as n from rounds x join papers p on p.question_id = x.question_id and priority <> 'low' and p.r <= x.round),
tops as (select question_id, round, list(paper_id) as top from k where n <= 5 group by all),
j as (select c.*, coalesce(len(list_intersect(t.top, b.top)) / 5.0::double, 0) as stability, exists (select 1 from papers p where p.question_id = c.question_id) as found from c left join tops t on c.question_id = t.question_id and c.round = t.round left join tops b on c.question_id = b.question_id and c.round = b.round + 1)
select question_id, round, case when not found or round < 2 then 'INSUFFICIENT_OBSERVATION' when new_papers < 2 and new_evidence < 3 and new_papers / greatest(1, papers - new_papers) < 1 and new_evidence / greatest(1, evidence - new_evidence) < 1 and stability >= 0.6 then 'SATURATED' else 'STILL_GAINING' end as state, new_papers, new_evidence, stability from j"""


@query(_SAT)
def DEC09_saturation(spark, d):
    l = links(spark, d)
    sup = l.where((~fn.is_weak("relevance")) & F.col("relation_type").isin(*fn.SUPPORTING))
    papers = sup.groupBy("question_id", "paper_id").agg(F.min("round").alias("round")).selectExpr("*", "case paper_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as priority", "(paper_id % 101) / 100.0D as score")
    evidence = l.select("question_id", "paper_id", "round").join(papers.select("question_id", "paper_id"), ["question_id", "paper_id"])
    rounds = l.groupBy("question_id").agg(F.max("round").alias("m")).select("question_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("round"))
    return coverage.saturation(rounds, papers, evidence)


_ASKED_OF = ["s_nationkey as task", "case when s_suppkey % 11 <> 0 then (s_suppkey % 10) / 10.0D end as importance", "s_suppkey % 3 > 0 as has_snapshot", "(s_suppkey % 5) / 5.0D as score", "s_suppkey % 13 = 0 as unavailable", "s_suppkey % 4 as evidence"]


@query(f"""with q as (select {', '.join(_ASKED_OF).replace('.0D', '.0::double')} from supplier), a as (select task, count(*) as questions, sum(evidence) as evidence, count(*) filter (importance >= 0.7) as important, count(*) filter (importance >= 0.7 and has_snapshot) as seen, count(*) filter (importance >= 0.7 and has_snapshot and (score > 0 or unavailable)) as covered from q group by 1),
t as (select n_nationkey as task, n_nationkey % 9 <> 0 as has_contract, n_nationkey % 7 <> 0 as active, coalesce(questions, 0) as questions, coalesce(evidence, 0) as evidence, coalesce(important, 0) as important, coalesce(seen, 0) as seen, coalesce(covered, 0) as covered from nation left join a on n_nationkey = task)
select task, case when not has_contract or not active or questions = 0 or evidence = 0 or (important > 0 and seen = 0) then 'failed' when seen < important and seen / important < 0.6 or important > 0 and covered = 0 then 'more' else 'ready' end as status,
  case when not has_contract then 'no contract' when not active then 'contract not active' when questions = 0 then 'no questions' when evidence = 0 then 'no evidence' when important > 0 and seen = 0 then 'no snapshot of an important question' when seen < important and seen / important < 0.6 then 'snapshots' when important > 0 and covered = 0 then 'coverage' else '' end as reason, questions, important, seen, covered from t""")
def DEC10_readiness(spark, d):
    """Nations as tasks, their suppliers as questions."""
    tasks = table(spark, d, "nation").selectExpr("n_nationkey as task", "n_nationkey % 9 <> 0 as has_contract", "n_nationkey % 7 <> 0 as active")
    return gates.readiness(tasks, table(spark, d, "supplier").selectExpr(*_ASKED_OF))


_CHECKED = "case when l_tax < 0.02 then 'failed' when l_tax < 0.04 then 'abstract_only' when l_tax < 0.06 then 'upgraded' else 'verified' end"
_QSTATE = "case s_suppkey % 7 when 0 then 'superseded' when 1 then 'covered' when 2 then 'partially_covered' else 'open' end"
_ADM = f"""with x as (select l_suppkey as q, l_partkey as paper_id, {LINKS[3].replace(' as relation_type', '')} as rel, round(abs(l_discount) * 10, 1) >= 0.5 as strong, {LINKS[6].replace(' as evidence_type', '')} as e, {_CHECKED} as v, l_linestatus = 'F' and l_tax >= 0.05 as loc from lineitem),
f as (select *, strong and rel in ('supports', 'partially_answers') and v in ('verified', 'upgraded', 'abstract_only') as sup, strong and rel = 'contradicts' and v in ('verified', 'upgraded') as con, e in ('limitation', 'negative_result') as lim from x),
b as (select q, count(*) as links, count(distinct case when sup then paper_id end) as papers, count(*) filter (sup and loc) as spans, count(*) filter (sup and lim) as limits, count(*) filter (sup and lim and loc) as ll, count(*) filter (con) as contra from f group by 1),
j as (select s_suppkey as question_id, {_QSTATE} as state, coalesce(links, 0) as links, coalesce(papers, 0) as papers, coalesce(spans, 0) as spans, coalesce(limits, 0) as limits, coalesce(ll, 0) as ll, coalesce(contra, 0) as contra from supplier left join b on q = s_suppkey),
r as (select *, case when state = 'superseded' then 'QUESTION_NOT_ELIGIBLE' when links = 0 then 'NO_LINKED_EVIDENCE' else concat_ws('; ', case when papers < 2 then 'INSUFFICIENT_INDEPENDENT_PAPERS' end, case when limits < 1 then 'NO_LIMITATION_SIGNAL' end, case when contra > 0 then 'UNRESOLVED_VERIFIED_CONTRADICTION' end, case when spans < 1 and not (papers >= 2 and limits > 0) then 'NO_FULLTEXT_LOCATABLE_EVIDENCE' end) end as reasons from j),
adm as (select question_id, case when state = 'superseded' then 'FAIL' when reasons = '' then 'PASS' else 'UNKNOWN' end as status, case when state = 'superseded' or links = 0 or (spans >= 1 and (limits < 1 or ll > 0)) then 'A' else 'B' end as tier, reasons, case when state = 'superseded' then 0 else papers end as papers, case when state = 'superseded' then 0 else spans end as spans from r)"""


def _admitted(spark, d):
    """Suppliers as questions, line items after the fifth as their evidence."""
    l = table(spark, d, "lineitem").selectExpr(*LINKS[:2], *LINKS[3:5], LINKS[6], f"{_CHECKED} as verification", "l_linestatus = 'F' and l_tax >= 0.05 as locatable")
    return gates.mining_admission(table(spark, d, "supplier").selectExpr("s_suppkey as question_id", f"{_QSTATE} as status"), l)


@query(_ADM + " select * from adm")
def DEC11_13_mining_admission(spark, d):
    return _admitted(spark, d).withColumn("reasons", F.array_join("reasons", "; "))


_GAPS = "case o_orderkey % 5 when 0 then 'novel_idea' when 1 then 'missing_evaluation' else 'boundary_gap' end"
_CAND = f"""with passed as (select s_suppkey as question_id from supplier where s_suppkey % 6 > 0), offered as (select distinct l_partkey as evidence_id, l_suppkey as question_id, l_partkey % 97 as paper_id, case when l_partkey % 4 = 0 then 'limitation' else 'method' end as evidence_type from lineitem where l_suppkey % 6 > 0 and l_partkey % 3 > 0),
asked as (select distinct l_orderkey as c, l_suppkey + case when l_orderkey % 7 = 0 then 1 else 0 end as q from lineitem where l_linenumber <= 2), cited as (select distinct l_orderkey as c, l_partkey as e from lineitem),
a as (select c, count(*) as n, count(*) filter (q in (select question_id from passed)) as k from asked group by 1), units as (select distinct evidence_id, paper_id, evidence_type from offered),
u as (select c, count(*) as usable, count(distinct paper_id) as papers, count(*) filter (evidence_type = 'limitation') as limits from cited join units on e = evidence_id group by 1),
o as (select cited.c, count(*) as own from cited join offered on e = evidence_id join asked on asked.c = cited.c and asked.q = offered.question_id group by 1)
select o_orderkey as candidate, case when o_orderkey % 5 = 0 then 'UNSUPPORTED_GAP_TYPE' when coalesce(n, 0) < 1 or k < n then 'UNKNOWN_QUESTION_ID' when coalesce(usable, 0) < 1 then 'UNKNOWN_EVIDENCE_ID' when coalesce(own, 0) < 1 then 'EVIDENCE_NOT_LINKED_TO_CITED_QUESTION' when o_orderkey % 11 = 0 then 'UNEXPECTED_CONTRADICTING_EVIDENCE' when papers < 2 then 'INSUFFICIENT_CANDIDATE_PAPER_SUPPORT' when limits < 1 then 'CANDIDATE_LACKS_LIMITATION_SIGNAL' end as reject
from orders left join a on a.c = o_orderkey left join u on u.c = o_orderkey left join o on o.c = o_orderkey"""


@query(_CAND)
def DEC12_candidate_validation(spark, d):
    """Orders as candidates that ask the suppliers of their first lines and cite their parts."""
    l = table(spark, d, "lineitem")
    cand = table(spark, d, "orders").selectExpr("o_orderkey as candidate", f"{_GAPS} as gap_type", "o_orderkey % 11 = 0 as contradicted")
    asked = l.where("l_linenumber <= 2").selectExpr("l_orderkey as candidate", "l_suppkey + case when l_orderkey % 7 = 0 then 1 else 0 end as question_id")
    offered = l.where("l_suppkey % 6 > 0 and l_partkey % 3 > 0").selectExpr("l_partkey as evidence_id", "l_suppkey as question_id", "l_partkey % 97 as paper_id", "case when l_partkey % 4 = 0 then 'limitation' else 'method' end as evidence_type")
    return gates.validate_candidates(cand, asked, l.selectExpr("l_orderkey as candidate", "l_partkey as evidence_id"), table(spark, d, "supplier").where("s_suppkey % 6 > 0").selectExpr("s_suppkey as question_id"), offered)


_SEARCH = f"""with {RANKED_SQL}, c as (select c_custkey as candidate, c_custkey % 2 = 1 as tight from customer), q as (select distinct candidate, query_id, case when family = '5-LOW' then '' else family end as family, case when query_id % 3 > 0 then 'completed' else 'failed' end as status from ranked),
r as (select ranked.candidate, ranked.query_id, case when source = 'N' then 'unknown' else source end as source, item from ranked where query_id % 3 > 0), qa as (select candidate, count(*) as n, count(*) filter (status = 'completed') as done, count(distinct nullif(family, '')) filter (status = 'completed') as f from q group by 1),
s as (select candidate, count(distinct source) filter (source <> 'unknown') as s from r group by 1), i as (select candidate, item from r union select candidate, item + 1 from ranked where query_id % 7 = 0), own as (select distinct candidate, item from ranked where rank = 0),
p as (select i.candidate, count(*) as papers, count(*) filter (own.item is null) as external from i left join own on own.candidate = i.candidate and own.item = i.item group by 1),
j as (select c.candidate, tight, coalesce(n, 0) as n, coalesce(done, 0) as done, coalesce(f, 0) as f, coalesce(s, 0) as s, coalesce(papers, 0) as papers, coalesce(external, 0) as external from c left join qa on qa.candidate = c.candidate left join s on s.candidate = c.candidate left join p on p.candidate = c.candidate),
w as (select *, case when n = 0 then 'NO_GAP_QUERIES' else concat_ws(',', case when done < case when tight then 1 else 2 end then 'INSUFFICIENT_COMPLETED_QUERIES' end, case when f < case when tight then 1 else 2 end then 'INSUFFICIENT_QUERY_FAMILIES' end, case when done / greatest(n, 1) < 0.5 then 'SEARCH_SUCCESS_RATE_TOO_LOW' end, case when s < 1 then 'NO_SUCCESSFUL_SOURCE' end, case when papers < case when tight then 2 else 3 end then 'INSUFFICIENT_GAP_SPECIFIC_PAPERS' end, case when external < 1 then 'NO_EXTERNAL_NEIGHBOR' end) end as reasons from j)
select candidate, case when reasons = '' then 'PASS' else 'UNKNOWN' end as status, reasons, case when n = 0 then 0 else papers end as papers, case when n = 0 then 0 else external end as external from w"""


@query(_SEARCH)
def DEC14_search_admission(spark, d):
    """Customers as candidates, every other one under constrained retrieval."""
    r = ranked(spark, d)
    q = r.selectExpr("candidate", "query_id", "case when family = '5-LOW' then '' else family end as family", "case when query_id % 3 > 0 then 'completed' else 'failed' end as status").distinct()
    out = gates.search_admission(
        table(spark, d, "customer").selectExpr("c_custkey as candidate", "c_custkey % 2 = 1 as constrained"), q, r.selectExpr("candidate", "query_id", "case when source = 'N' then 'unknown' else source end as source", "item"),
        r.where("query_id % 7 = 0").selectExpr("candidate", "item + 1 as item"), r.where("rank = 0").select("candidate", "item"),
    )
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query("with own as (select distinct l_orderkey as c, l_partkey as p from lineitem where l_returnflag = 'A'), l as (select l_orderkey, l_partkey, l_suppkey as q, date_trunc('month', l_shipdate) as m from lineitem), qs as (select distinct l_orderkey as c, q, m from l), cand as (select distinct qs.c, l_partkey as p from qs join l on l.q = qs.q and l.m = qs.m) select c, p from cand where not exists (select 1 from own where own.c = cand.c and own.p = cand.p)")
def DEC15_corpus_neighbours(spark, d):
    """A supplier's month stands for a question; its parts are the neighbours."""
    t = table(spark, d, "lineitem").withColumn("m", F.date_trunc("month", "l_shipdate"))
    qs = t.select(F.col("l_orderkey").alias("c"), "l_suppkey", "m").distinct()
    parts = t.select("l_suppkey", "m", F.col("l_partkey").alias("p")).distinct()
    return coverage.neighbours(qs, parts, t.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("p")), ["l_suppkey", "m"])


@query(f"with {RANKED_SQL}, a as (select candidate, item, count(*) as h, count(distinct family) as f, min(rank) as r, count(distinct source) as s from ranked group by all) select candidate, item, round(0.4::double * h + 0.3::double * f + 0.2::double / (r + 1) + 0.1::double * s + 0.1::double * case when item % 3 = 0 then 0 else (item % 11) / 10.0::double end, 6) as score from a")
def DEC16_neighbour_score(spark, d):
    a = ranked(spark, d).groupBy("candidate", "item").agg(F.count("*").alias("h"), F.countDistinct("family").alias("f"), F.min("rank").alias("r"), F.countDistinct("source").alias("s"))
    return a.select("candidate", "item", F.round(fn.neighbour_score("h", "f", "r", "s", F.expr("case when item % 3 = 0 then null else (item % 11) / 10.0D end")), 6).alias("score"))


_LEVEL = "case {} % 3 when 0 then 1.0::double when 1 then 0.5::double else 0.0::double end"


@query(f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(0.4::double * {_LEVEL.format('l_partkey')} + 0.35::double * {_LEVEL.format('l_suppkey')} + 0.25::double * {_LEVEL.format('l_linenumber')}, 4)::double as relevance from lineitem")
def DEC17_relevance_aggregate(spark, d):
    v = {"yes": 1.0, "partial": 0.5}
    level = lambda k: F.when(F.col(k) % 3 == 0, v["yes"]).when(F.col(k) % 3 == 1, v["partial"]).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.bround(0.4 * level("l_partkey") + 0.35 * level("l_suppkey") + 0.25 * level("l_linenumber"), 4).alias("relevance"))


_CLAIMS = "claims as (select l_orderkey as candidate_id, l_linenumber % 3 as claim_id, case l_partkey % 5 when 0 then 'FULL' when 1 then 'PARTIAL' when 2 then 'UNCERTAIN' when 3 then 'NONE' end as coverage from lineitem)"
_VERDICT = f"with {_CLAIMS}, c as (select candidate_id, claim_id, case when count(coverage) = 0 then 'UNCERTAIN' when bool_or(coverage = 'FULL') then 'FULL' when bool_or(coverage = 'PARTIAL') then 'PARTIAL' when bool_or(coverage = 'UNCERTAIN') then 'UNCERTAIN' else 'NONE' end as v from claims group by all), b as (select candidate_id, count(*) filter (v = 'UNCERTAIN') as u, count(*) filter (v = 'NONE') as n, count(*) filter (v = 'PARTIAL') as p, coalesce(list_sort(list(claim_id) filter (v in ('NONE', 'PARTIAL'))), []) as residual from c group by 1), r as (select candidate_id, case when u > 0 then 'uncertain' when n = 0 and p = 0 then 'closed' when p = 0 then 'confirmed' else 'partially_closed' end as result, case when u > 0 then 'more_search' when n = 0 and p = 0 then 'reject' when p = 0 then 'continue' else 'narrow' end as action, array_to_string(residual, ',') as residual from b)"


def _verdicts(spark, d):
    cover = F.expr("case l_partkey % 5 when 0 then 'FULL' when 1 then 'PARTIAL' when 2 then 'UNCERTAIN' when 3 then 'NONE' end")
    return gates.claim_verdict(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), (F.col("l_linenumber") % 3).alias("claim_id"), cover.alias("coverage"))).withColumn("residual", F.array_join(F.col("residual").cast("array<string>"), ","))


@query(_VERDICT + " select candidate_id, result, action, residual, case when action = 'continue' and result = 'confirmed' then 'surviving' when action = 'reject' or result = 'closed' then 'rejected' when action = 'narrow' or result = 'partially_closed' then 'audited' else 'auditing' end as status from r")
def DEC18_22_verdict_transition(spark, d):
    return _verdicts(spark, d).withColumn("status", gates.transition("action", "result"))


@query(_VERDICT + ", x as (select r.*, (candidate_id % 10) / 10.0::double as novelty, (candidate_id % 7) / 10.0::double as sim, (candidate_id % 9) / 10.0::double as conv, candidate_id % 4 as prior from r) select candidate_id, case when result = 'confirmed' and ((novelty > 0.8 and sim < 0.3) or (conv < 0.4 and prior < 2)) then 'uncertain' else result end as result, case when result = 'confirmed' and novelty > 0.8 and sim < 0.3 then least(novelty, 0.5) else novelty end as novelty from x")
def DEC19_20_downgrades(spark, d):
    x = _verdicts(spark, d).selectExpr("candidate_id", "result", "(candidate_id % 10) / 10.0D as novelty", "(candidate_id % 7) / 10.0D as sim", "(candidate_id % 9) / 10.0D as conv", "candidate_id % 4 as prior")
    far = (F.col("result") == "confirmed") & (F.col("novelty") > 0.8) & (F.col("sim") < 0.3)
    loose = (F.col("result") == "confirmed") & (F.col("conv") < 0.4) & (F.col("prior") < 2)
    return x.select("candidate_id", F.when(far | loose, "uncertain").otherwise(F.col("result")).alias("result"), F.when(far, F.least("novelty", F.lit(0.5))).otherwise(F.col("novelty")).alias("novelty"))


_AUD = "a as (select o_custkey as c, o_orderkey as seq, o_orderkey % 4 > 0 as decided, case when o_orderkey % 3 = 0 then 'continue' else 'more_search' end as action, case when o_orderkey % 5 > 0 then 'claim ' || (o_custkey % 4) end as claim, [o_orderkey % 2, o_custkey % 3] as n from orders)"


@query(f"with {_AUD}, p as (select c, arg_max((action, claim, n), seq) as p from a where decided group by 1), x as (select c_custkey as candidate, 'claim ' || (c_custkey % 4) as claim, [c_custkey % 3, c_custkey % 2, c_custkey % 3] as n from customer) select candidate, coalesce(p[1] = 'more_search' and p[2] = claim and list_sort(list_distinct(p[3])) = list_sort(list_distinct(n)), false) as repeated from x left join p on c = candidate")
def DEC21_repeat_detection(spark, d):
    """Orders as a customer's audits, a fourth of them undecided."""
    audits = table(spark, d, "orders").selectExpr("o_custkey as candidate", "o_orderkey as seq", "o_orderkey % 4 > 0 as decided", "case when o_orderkey % 3 = 0 then 'continue' else 'more_search' end as action", "case when o_orderkey % 5 > 0 then concat('claim ', o_custkey % 4) end as claim", "array(o_orderkey % 2, o_custkey % 3) as neighbours")
    now = table(spark, d, "customer").selectExpr("c_custkey as candidate", "concat('claim ', c_custkey % 4) as claim", "array(c_custkey % 3, c_custkey % 2, c_custkey % 3) as neighbours")
    return gates.repeats(now, audits)


_FALL = f"with {RANKED_SQL}, s as (select candidate, family, query_id, list_distinct(list(item)) as items from ranked where rank < {{k}} group by all), p as (select x.candidate, x.family, len(list_intersect(x.items, y.items)) / len(list_distinct(list_concat(x.items, y.items))) as j, len(list_intersect(x.items, y.items)) / least(len(x.items), len(y.items)) as o from s x join s y on x.candidate = y.candidate and x.family = y.family and x.query_id < y.query_id)"
_FALLS = " union all ".join(f"({_FALL.format(k=k)} select candidate, family, {k} as k, round(median(j), 6) as jaccard, round(median(o), 6) as overlap from p group by all)" for k in (5, 10, 20))


@query(_FALLS)
def DEC23_24_overlap_waterfall(spark, d):
    """Pairs of a candidate's and family's queries are joined once; the three depths are prefixes of the same lists."""
    s = ranked(spark, d).where("rank < 20").groupBy("candidate", "family", "query_id", "item").agg(F.min("rank").alias("rank")).groupBy("candidate", "family", "query_id").agg(F.collect_list(F.struct("rank", "item")).alias("l"))
    p = s.alias("x").join(s.alias("y"), ["candidate", "family"]).where("x.query_id < y.query_id").select("candidate", "family", F.col("x.l").alias("a"), F.col("y.l").alias("b"), F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("k"))
    upto = lambda c: F.transform(F.filter(c, lambda x: x["rank"] < F.col("k")), lambda x: x["item"])
    p = p.select("candidate", "family", "k", upto("a").alias("a"), upto("b").alias("b")).where("size(a) > 0 and size(b) > 0").select("candidate", "family", "k", fn.jaccard("a", "b").alias("j"), fn.overlap("a", "b").alias("o"))
    return p.groupBy("candidate", "family", "k").agg(F.round(F.median("j"), 6).alias("jaccard"), F.round(F.median("o"), 6).alias("overlap"))


@query(f"with {RANKED_SQL}, r as (select candidate, item, row_number() over (partition by candidate order by coalesce(nullif(item % 7, 0), 0) desc, coalesce(nullif(item % 5, 0), 0) desc, item, query_id, rank) as n from ranked) select candidate, item as nearest, case when item % 2 = 0 then 'residual ' || item else 'none' end as residual from r where n = 1")
def DEC25_nearest_prior(spark, d):
    key = F.struct(-F.coalesce(F.nullif(F.col("item") % 7, F.lit(0)), F.lit(0)), -F.coalesce(F.nullif(F.col("item") % 5, F.lit(0)), F.lit(0)), "item")
    n = ranked(spark, d).groupBy("candidate").agg(F.min_by("item", key).alias("nearest"))
    return n.select("candidate", "nearest", F.when(F.col("nearest") % 2 == 0, F.concat(F.lit("residual "), F.col("nearest").cast("string"))).otherwise("none").alias("residual"))


_NARROW = ["candidate_id as candidate", "result", "case when residual = '' then null else concat(' not covered: ', residual, ' ') end as remaining", "candidate_id % 5 as attempts", "case when candidate_id % 9 = 0 then concat('not covered: ', residual) else 'all' end as claimed", "case when candidate_id % 2 = 0 then 'known' end as existing", "case candidate_id % 3 when 0 then 'known' when 1 then 'a survey' end as summary"]


@query(_VERDICT + f", g as (select {', '.join(_NARROW).replace('residual', 'repeat(residual, 4)').replace(chr(39) + chr(39) + ' then null', chr(39) + chr(39) + ' then null')} from r), k as (select candidate, case when result <> 'partially_closed' then 'NO_PARTIALLY_CLOSED_AUDIT' when length(trim(coalesce(remaining, ''))) < 20 then 'NO_CONCRETE_REMAINING_DELTA' when attempts > 2 then 'NARROW_ATTEMPTS_EXHAUSTED' when trim(claimed) = trim(coalesce(remaining, '')) then 'DELTA_UNCHANGED' end as skip, case when summary is not null and not contains(coalesce(existing, ''), summary) then ltrim(coalesce(existing, '') || chr(10) || '[narrowed after audit] ' || summary, chr(10)) else coalesce(existing, '') end as coverage from g) select candidate, skip, case when skip is null then coverage end as coverage from k")
def DEC26_narrowing(spark, d):
    return gates.narrowing(_verdicts(spark, d).withColumn("residual", F.repeat("residual", 4)).selectExpr(*_NARROW))


@query("with g as (select doc_id, case when n_chars >= 500 then 'PASS' else 'FAIL' end as evidence, case when quality is null then 'UNKNOWN' when quality = 1 then 'PASS' else 'FAIL' end as novelty, case when regexp_matches(lower(d.text), 'idiot|scum') then 'WARN' else 'PASS' end as feasible, coalesce(toxic, 0) = 0 as complete from documents d left join labels using (doc_id)) select doc_id, evidence, novelty, feasible, case when 'FAIL' in (evidence, novelty, feasible) then 'C' when evidence = 'PASS' and novelty = 'PASS' and feasible = 'PASS' and complete then 'A' else 'B' end as tier from g")
def DEC27_28_gates_tier(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    terms = F.array(F.lit("idiot"), F.lit("scum"))
    g = t.select("doc_id", F.when(F.col("n_chars") >= 500, "PASS").otherwise("FAIL").alias("evidence"), F.when(F.col("quality").isNull(), "UNKNOWN").when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("novelty"), F.when(F.exists(terms, lambda x: F.contains(F.lower("text"), x)), "WARN").otherwise("PASS").alias("feasible"), (F.coalesce("toxic", F.lit(0)) == 0).alias("complete"))
    every = F.array("evidence", "novelty", "feasible")
    tier = F.when(F.array_contains(every, "FAIL"), "C").when((F.size(F.array_except(every, F.array(F.lit("PASS")))) == 0) & F.col("complete"), "A").otherwise("B")
    return g.select("doc_id", "evidence", "novelty", "feasible", tier.alias("tier"))


_DIMS = ["novelty", "feasibility", "significance", "evidence", "differentiation", "experiment", "impact", "risk"]
_IDEAS = ", ".join(f"(p_partkey % {m}) / {m - 1}.0{{0}} as {n}" for n, m in zip(_DIMS, (11, 13, 17, 19, 23, 29, 31, 37)))
_IDEA = "0.2::double * (novelty + feasibility + significance + evidence) + 0.1::double * differentiation + 0.05::double * experiment + 0.05::double * impact - 0.08::double * risk"


@query(f"with i as (select p_partkey, p_size, {_IDEAS.format('::double')} from part), s as (select p_partkey, {_IDEA} as s, least(0.15::double, 0.05::double * (p_size % 5)) + least(0.2::double, 0.08::double * (p_size % 4)) as pen from i) select p_partkey, round(case when pen > 0 then greatest(s - pen, 0) else s end, 6) as score, case when round(case when pen > 0 then greatest(s - pen, 0) else s end, 6) >= 0.7 then 'go' when round(case when pen > 0 then greatest(s - pen, 0) else s end, 6) >= 0.5 then 'revise' else 'reject' end as decision from s")
def DEC29_30_idea_score(spark, d):
    i = table(spark, d, "part").selectExpr("p_partkey", "p_size", *_IDEAS.format("D").split(", "))
    pen = F.least(F.lit(0.15), 0.05 * (F.col("p_size") % 5)) + F.least(F.lit(0.2), 0.08 * (F.col("p_size") % 4))
    s = F.round(F.when(pen > 0, F.greatest(fn.idea_score() - pen, F.lit(0.0))).otherwise(fn.idea_score()), 6)
    return i.select("p_partkey", s.alias("score"), fn.tier(s, 0.7, 0.5, ("go", "revise", "reject")).alias("decision"))


@query(f"with {SCORES_SQL} select paper_id, round(case when top_venue then least(a + 0.1::double, 1) else a end, 6) as authority from (select *, case when citation_count = 0 and year is null then authority * 0.6::double when citation_count = 0 then authority * 0.85::double when citation_count >= 100 then least(authority + 0.1::double, 1) when citation_count >= 10 then least(authority + 0.05::double, 1) else authority end as a from scores)")
def DEC02_authority(spark, d):
    return scores(spark, d).select("paper_id", F.round(fn.adjust_authority("authority", "citation_count", "year", "top_venue"), 6).alias("authority"))


_STATE = "select user_id, count(*) as rounds, count(*) filter (event_type = 'purchase') as high, round(1 - count(distinct event_type) / greatest(count(*), 1), 6) as dup from events group by 1"


@query(f"select user_id, rounds >= 75 or high >= 15 as stop, (high < 10 and rounds >= 2) or (dup > 0.65 and rounds >= 2) as early from ({_STATE})")
def DEC31_32_stop_policy(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("rounds"), F.count_if(F.col("event_type") == "purchase").alias("high"), F.round(1 - F.countDistinct("event_type") / F.greatest(F.count("*"), F.lit(1)), 6).alias("dup"))
    return s.select("user_id", ((F.col("rounds") >= 75) | (F.col("high") >= 15)).alias("stop"), (((F.col("high") < 10) & (F.col("rounds") >= 2)) | ((F.col("dup") > 0.65) & (F.col("rounds") >= 2))).alias("early"))


@query("with f as (select user_id, date_trunc('week', ts)::date as week, event_type, count(*) as used from events group by all), t as (select user_id, week, sum(used) as total, min(used) as least_used, count(*) as families from f group by all) select user_id, week, total::bigint as total, total < 3 or (total < 8 and (least_used < 2 or families < 5)) as allowed, case when total >= 8 then 'total budget' when least_used >= 2 and families >= 5 then 'family budget' end as refused from t")
def DEC33_39_ST15_budget_ledger(spark, d):
    f = table(spark, d, "events").groupBy("user_id", F.date_trunc("week", "ts").cast("date").alias("week"), "event_type").agg(F.count("*").alias("used"))
    t = f.groupBy("user_id", "week").agg(F.sum("used").alias("total"), F.min("used").alias("least"), F.count("*").alias("families"))
    spent = (F.col("least") >= 2) & (F.col("families") >= 5)
    return t.select("user_id", "week", "total", ((F.col("total") < 3) | ((F.col("total") < 8) & ~spent)).alias("allowed"), F.when(F.col("total") >= 8, "total budget").when(spent, "family budget").alias("refused"))


@query(_VERDICT + " select candidate_id, case when action = 'more_search' then 'inconclusive' else 'auditing' end as status from r")
def DEC34_inconclusive(spark, d):
    return _verdicts(spark, d).select("candidate_id", F.when(F.col("action") == "more_search", "inconclusive").otherwise("auditing").alias("status"))


@query("select doc_id, case when quality = 1 then 'upgraded' else 'abstract_only' end as status, case when quality = 1 then 0.6::double else 0.4::double end as confidence from documents left join labels using (doc_id)")
def DEC36_37_upgrade_confidence(spark, d):
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return t.select("doc_id", F.when(F.col("quality") == 1, "upgraded").otherwise("abstract_only").alias("status"), F.when(F.col("quality") == 1, 0.6).otherwise(0.4).alias("confidence"))


@query("with q as (select conv_id, count(*) as n, count(distinct role) as axes, count(*) filter (trim(text) = '') as blank, count(*) - count(distinct lower(text)) as twice from conversations group by 1) select conv_id, n between 5 and 12 and axes >= 3 and blank = 0 and twice = 0 as valid, n >= 1 as enough from q")
def DEC35_40_decomposition_valid(spark, d):
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("axes"), F.count_if(F.trim("text") == "").alias("blank"), (F.count("*") - F.countDistinct(F.lower("text"))).alias("twice"))
    return q.select("conv_id", (F.col("n").between(5, 12) & (F.col("axes") >= 3) & (F.col("blank") == 0) & (F.col("twice") == 0)).alias("valid"), (F.col("n") >= 1).alias("enough"))


@query("with n as (select doc_id, source, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) as q from documents where source in ('src1', 'src2', 'src3')), f as (select source, q, min(doc_id) as id from n group by all), r as (select *, row_number() over (partition by source order by id) as k from f) select source, q, id from r where k <= 10")
def DEC41_valid_queries(spark, d):
    n = table(spark, d, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source", fn.normalise_query("text").alias("q"))
    f = n.groupBy("source", "q").agg(F.min("doc_id").alias("id"))
    return f.withColumn("k", ranking.ordinal(["source"], "id")).where("k < 10").select("source", "q", "id")


_TASKS = "select s_suppkey as task, case s_suppkey % 3 when 0 then 'more_research_required' when 1 then 'done' end as terminal from supplier"
_ASKED = "p_partkey % 40 + 1 as task, p_partkey as question_id, p_name as question, (p_partkey % 10) / 10.0D as importance, case when p_partkey % 3 > 0 then (p_partkey % 7) / 10.0D end as score"


@query(f"with t as ({_TASKS}), q as (select {_ASKED.replace('.0D', '.0::double')} from part), l as (select *, row_number() over (partition by task order by question_id) as n from q where importance >= 0.7 and (score is null or score < 0.3)), n as (select task, string_agg(left(question, 40), '; ' order by n) filter (n <= 3) as names from l group by 1), e as (select distinct l_suppkey as task from lineitem where l_partkey % 4 = 0), g as (select o_custkey as task, count(*) as partial from orders where o_orderstatus <> 'F' group by 1), s as (select t.task, concat_ws(' | ', 'search: ' || names, case when e.task is null then 'limitations' end, 'upgrade: ' || partial, case when terminal = 'more_research_required' then 'source access' end) as steps from t left join n on n.task = t.task left join e on e.task = t.task left join g on g.task = t.task) select task, case when steps = '' then 'go on' else steps end as steps from s")
def DEC38_recommendations(spark, d):
    """Suppliers as tasks, parts as questions, customers' orders as candidates."""
    tasks = table(spark, d, "supplier").selectExpr("s_suppkey as task", "case s_suppkey % 3 when 0 then 'more_research_required' when 1 then 'done' end as terminal")
    q = table(spark, d, "part").selectExpr(*_ASKED.split(", "))
    e = table(spark, d, "lineitem").selectExpr("l_suppkey as task", "l_partkey % 4 = 0 as limiting")
    g = table(spark, d, "orders").selectExpr("o_custkey as task", "case when o_orderstatus = 'F' then 'complete' else 'partial' end as provenance")
    return gates.next_steps(q, e, g, tasks).withColumn("steps", F.array_join("steps", " | "))


# Text ----------------------------------------------------------------------------------------


@query(f"with {_HEADED}, h as (select doc_id, trim(regexp_replace(lower(trim(line)), '^#+', '')) as h from raw) select doc_id, coalesce(case when length(h) <= 80 then {_named(text.SECTIONS, 'h', '{}')} end, 'none') as section, count(*) as lines from h group by all")
def TXT01_sections(spark, d):
    lines = headed(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id", F.coalesce(text.classify_heading(F.col("line")), F.lit("none")).alias("section")).agg(F.count("*").alias("lines"))


_STRICT = _named(text.STRICT_SECTIONS, "trim(lower(line))", "^(\\d+\\.?\\s*)?({})")


@query(f"with {_HEADED}, h as (select *, case when length(trim(line)) < 60 then {_STRICT} end as h from raw), s as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row), 'introduction') as section from h) select doc_id, section, count(*) as lines, sum(length(trim(line)))::bigint as chars from s where h is null group by all")
def TXT02_strict_sections(spark, d):
    return text.strict_sections(headed(spark, d), "doc_id")


@query(f"with {_HEADED}, t2 as (select doc_id, string_agg(line, chr(10) order by i) as t from raw group by 1) select doc_id, array_to_string(regexp_extract_all(t, '{text.MARKS}'), '|') as marks, len(list_filter(regexp_split_to_array(regexp_replace(t, '{text.MARKS}', '', 'g'), '\\s+'), lambda w: w <> '')) as words from t2")
def TXT03_04_marks_words(spark, d):
    t = headed(spark, d)
    return t.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(text.MARKS), F.lit(0)), "|").alias("marks"), text.word_count(F.col("text")).alias("words"))


_CITING = "concat('see [P', doc_id % 30, '], [P', doc_id % 7, '] and [P', doc_id % 30, '] or [P99999999999]; ', source)"


@query(f"with t as (select doc_id, {_CITING} as t from documents), c as (select doc_id, t, list_distinct(regexp_extract_all(t, '\\[P(\\d+)\\]', 1)) as n from t), g as (select *, list_filter(n, lambda x: x::bigint between 1 and 20) as good, list_filter(n, lambda x: x::bigint not between 1 and 20) as bad from c) select doc_id, list_reduce(list_prepend(t, bad), lambda a, x: replace(a, '[P' || x || ']', '[unsupported]')) as cleaned, len(good) / 20 as coverage, len(good) / 20 < 0.3 as low from g")
def TXT06_citation_check(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{_CITING} as t")
    clean, share = text.check_citations(F.col("t"), 20)
    return t.select("doc_id", clean.alias("cleaned"), share.alias("coverage"), (share < 0.3).alias("low"))


_NOTED = "concat(text, case doc_id % 11 when 0 then '（此部分保持不变）' when 1 then ' (the rest remains unchanged)' when 2 then '（待补充）' when 3 then '(omitted here)' when 4 then '（见图）' when 5 then '（其余内容不变）' else '' end)"
_HOLDERS = "|".join(text.PLACEHOLDERS)


@query(f"with t as (select doc_id, {_NOTED} as text from documents) select doc_id, regexp_matches(text, '{_HOLDERS}') as placeholder, len(list_filter(regexp_split_to_array(text, '[\\n;；.]'), lambda x: length(trim(x)) > 3)) as parts from t")
def TXT07_08_WIK08_components(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{_NOTED} as t")
    return t.select("doc_id", text.is_placeholder(F.col("t")).alias("placeholder"), F.size(F.filter(F.split("t", r"[\n;；.]"), lambda x: F.length(F.trim(x)) > 3)).alias("parts"))


@query("with t as (select doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as n from documents) select doc_id, array_to_string(list_sort(list_filter(n, lambda x: x not in ('This', 'That', 'With')))[1:100], ',') as names from t")
def TXT09_names(spark, d):
    n = F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,}"), F.lit(0))), F.array(F.lit("This"), F.lit("That"), F.lit("With")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(n), 1, 100), ",").alias("names"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents), s as (select doc_id, i, line, sum((length(line) < 60)::int) over (partition by doc_id order by i) as g from l) select doc_id, g::bigint as section, count(*) as lines, sum(length(line))::bigint as chars from s group by all")
def TXT10_13_markdown_sections(spark, d):
    """Short lines stand in for headings: the last one above a line names its section."""
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    g = F.sum((F.length("line") < 60).cast("int")).over(Window.partitionBy("doc_id").orderBy("i"))
    return l.withColumn("section", g).groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_PAPER = "concat('On ', case doc_id % 13 when 0 then 'a Survey of' when 1 then 'the Dataset' when 2 then 'negative results' when 3 then 'tutorial and evaluation' when 4 then 'what we Cannot do in' else '' end, ' ', source)"


@query(f"with t as (select doc_id, lower({_PAPER}) || ' ' || lower(text) as t, n_chars % 300 as cites from documents), r as (select doc_id, unnest([case when regexp_matches(t, 'survey|review|tutorial|comprehensive') then 'survey' end, case when cites > 100 then 'seminal' end, case when regexp_matches(t, 'benchmark|dataset|evaluation') then 'benchmark' end, case when regexp_matches(t, 'negative|failure|limitation|cannot') then 'negative_result' end]) as role from t) select doc_id, role from r where role is not null union all select doc_id, 'method' from documents d where not exists (select 1 from r where r.doc_id = d.doc_id and role is not null)")
def TXT14_role_tagging(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{_PAPER} as title", "text", "n_chars % 300 as cites")
    return t.select("doc_id", F.explode(text.roles(F.col("title"), F.col("text"), F.col("cites"))).alias("role"))


@query("with t as (select p_partkey, unnest(['{topic} survey', '{topic} limitations', 'benchmark for {topic}']) as tpl, p_name from part) select p_partkey, replace(tpl, '{topic}', p_name) as q from t union all select p_partkey, concat_ws(' ', p_brand, nullif(p_type, ''), 'negative result') from part")
def TXT15_17_query_templates(spark, d):
    p = table(spark, d, "part")
    seeds = F.array(*[F.lit(x) for x in ("{topic} survey", "{topic} limitations", "benchmark for {topic}")])
    a = p.select("p_partkey", "p_name", F.explode(seeds).alias("tpl")).select("p_partkey", F.replace("tpl", F.lit("{topic}"), "p_name").alias("q"))
    return a.unionAll(p.select("p_partkey", F.concat_ws(" ", "p_brand", fn.blank_to_null("p_type"), F.lit("negative result"))))


@query("with t as (select doc_id, [source || ' evaluation', left(text, 200)] as v, ['Tion', ' ING ', null, '', source, 'zz' || (doc_id % 3)] as terms, case when doc_id % 4 > 0 then lang end as scope from documents), m as (select *, list_filter(list_filter(list_transform(terms, lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), lambda x: not list_bool_or(list_transform(v, lambda y: contains(lower(y), lower(x))))) as miss from t) select doc_id, array_to_string(list_concat(v, list_transform(miss, lambda x: trim(x || ' ' || coalesce(scope, '')))), '|') as queries from m")
def TXT16_term_coverage(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "array(concat(source, ' evaluation'), left(text, 200)) as v", "array('Tion', ' ING ', null, '', source, concat('zz', doc_id % 3)) as terms", "case when doc_id % 4 > 0 then lang end as scope")
    return t.select("doc_id", F.array_join(text.cover_terms(F.col("terms"), F.col("v"), F.col("scope")), "|").alias("queries"))


@query("with n as (select conv_id, turn, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) as cjk, length(text) as l from conversations) select conv_id, sum(cjk + ceil((l - cjk) / 3.2::double) + 4)::bigint as tokens from n group by 1")
def TXT18_ST11_token_estimate(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(fn.token_estimate("text") + 4).alias("tokens"))


@query("select doc_id, case when doc_id % 2 = 0 then doc_id % 10 end as position, split_part(text, '. ', 1) as topic, nullif(regexp_extract(lower('10.48550/arXiv.21' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '.' || lpad(doc_id::varchar, 5, '0')), 'arxiv\\.(\\d{4}\\.\\d{4,5})', 1), '') as arxiv_id from documents")
def TXT19_20_21_ids(spark, d):
    doi = F.expr("concat('10.48550/arXiv.21', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '.', lpad(cast(doc_id as string), 5, '0'))")
    mark = F.expr("case when doc_id % 2 = 0 then concat('[P', doc_id % 10, ']') else 'x' end")
    pos = F.when(mark.rlike(r"^\[[pP]\d+\]$"), F.regexp_extract(mark, r"(\d+)", 1).cast("long"))
    return table(spark, d, "documents").select("doc_id", pos.alias("position"), F.split_part("text", F.lit(". "), F.lit(1)).alias("topic"), fn.arxiv_in_doi(doi).alias("arxiv_id"))


@query("select doc_id, sha256(text) as sha, md5(source || ':' || text) as cache_key from documents")
def HSH01_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.concat("source", F.lit(":"), "text").cast("binary")).alias("cache_key"))


_HASHED = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::hugeint)::varchar" for k in range(5))


@query(f"with {LINKS_SQL}, e as (select question_id as q, sha256(concat_ws(chr(31), 'e', evidence_id::varchar, paper_id::varchar, evidence_type, case when fulltext then 'verified' else '' end, printf('%.3f', confidence))) as h from links), l as (select question_id as q, sha256(concat_ws(chr(31), 'l', question_id::varchar, evidence_id::varchar, relation_type, printf('%.3f', relevance))) as h from links) select q as question_id, sha256(concat_ws(',', count(*)::varchar, {_HASHED})) as version from (select * from e union all select * from l) group by 1")
def HSH02_04_pool_fingerprint(spark, d):
    l = links(spark, d)
    e = l.selectExpr("question_id", "evidence_id as id", "paper_id", "evidence_type as type", "case when fulltext then 'verified' end as status", "confidence")
    return state.pool_fingerprint(e, l.selectExpr("question_id", "evidence_id as id", "relation_type as relation", "relevance"), "question_id")


_TALK = "select conv_id, min(case when turn = 0 then text end) as task_input, min(case when turn = 1 then '  ' || text || ' ' end) as state_input, 'v' || (conv_id % 3) as pipeline_version from conversations group by conv_id"


@query(f"with t as ({_TALK}), f as (select conv_id, list(coalesce(text, '') order by turn) filter (role = 'user') as a, list(coalesce(text, '') order by turn) filter (role = 'system') as r from conversations group by 1) select t.conv_id, sha256(to_json(struct_pack(clarification_answers := coalesce(a, []::varchar[]), pipeline_version := pipeline_version, research_feedbacks := coalesce(r, []::varchar[]), state_user_feedback := '', state_user_input := regexp_replace(coalesce(state_input, ''), '^\\s+|\\s+$', '', 'g'), task_user_input := regexp_replace(coalesce(task_input, ''), '^\\s+|\\s+$', '', 'g')))::varchar) as version from t join f using (conv_id)")
def HSH03_contract_version(spark, d):
    """A conversation's first turns as inputs, its users' turns as answers, system turns as feedback."""
    c = table(spark, d, "conversations")
    tasks = c.groupBy("conv_id").agg(F.min(F.expr("case when turn = 0 then text end")).alias("task_input"), F.min(F.expr("case when turn = 1 then concat('  ', text, ' ') end")).alias("state_input"), F.lit(None).cast("string").alias("state_feedback"))
    told = c.selectExpr("conv_id", "turn as seq", "case role when 'user' then 'clarification_answer' when 'system' then 'research_feedback' end as kind", "text as content")
    return state.contract_version(tasks.withColumn("pipeline_version", F.expr("concat('v', conv_id % 3)")), told, "conv_id")


_TRIES = "a as (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as round, row_number() over (partition by user_id order by ts, event_id) as seq, event_type in ('view', 'purchase') as ok, case when event_type not in ('view', 'purchase') then 'e' || (event_id % 3) end as error from events)"


@query(f"with {_TRIES}, b as (select *, row_number() over w as n, coalesce(bool_or(ok) over (partition by user_id, round order by seq rows between unbounded preceding and 1 preceding), false) as won from a window w as (partition by user_id, round order by seq)), k as (select *, case when ok then 1 when n = 3 then -1 else 0 end as e from b where not won and n <= 3), g as (select *, sum((lag_error is null or lag_error <> error or ok)::int) over (partition by user_id order by seq) as run, sum((e = -1)::int) over (partition by user_id order by seq) as lost from (select *, lag(error) over (partition by user_id order by seq) as lag_error from k)), s as (select *, case when not ok then row_number() over (partition by user_id, run order by seq) end as same from g), y as (select *, case when same >= 3 then 'identical_error' when lost >= 5 then 'failed_budget' end as why from s), z as (select *, min(case when why is not null then seq end) over (partition by user_id) as stop from y) select user_id, count(*) filter (e = 1) as completed, count(*) filter (e = -1) as failed, max(case when seq = stop then why end) as stopped from z where stop is null or seq <= stop group by 1")
def ST04_rounds_with_retry(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    good = F.col("event_type").isin("view", "purchase")
    a = table(spark, d, "events").select("user_id", F.floor((n - 1) / 4).alias("round"), n.alias("seq"), good.alias("ok"), F.when(~good, F.expr("concat('e', event_id % 3)")).alias("error"))
    return state.round_outcomes(a, "user_id")


_BAG = "list_transform(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::int % 16)"


@query(f"with t as (select doc_id, coalesce(nullif(substr(case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then null else text end, 1, 8000), ''), ' ') as x from documents), b as (select doc_id, {_BAG} as b from t) select doc_id, array_to_string(list_transform(range(0, 16), lambda j: len(list_filter(b, lambda y: y = j))), ',') as vec from b")
def VEC02_embed(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "case when doc_id % 50 = 0 then '' when doc_id % 50 = 1 then null else text end as text")
    return vectors.embed(t, 16, vectors.hashed_bag(16)).select("doc_id", F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",").alias("vec"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso, json_extract(props, '$.k')::bigint as k, least(greatest(value / 100, 0), 1) as clamped from events")
def DAT01_MTH01_JSN01_scalars(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.from_json("props", "k long")["k"].alias("k"), fn.clamp(F.col("value") / 100).alias("clamped"))


# State ---------------------------------------------------------------------------------------


@query("with r as (select *, row_number() over (partition by user_id order by ts desc) as n from events) select event_id, user_id from r where n <= 20")
def ST01_bounded_queue(spark, d):
    return state.newest(table(spark, d, "events"), "user_id", "ts", 20).select("event_id", "user_id")


@query("with l as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts) as p from events) select user_id, count(*) filter (epoch(ts) - epoch(p) >= 43200) as keep_alives from l group by 1")
def ST02_keep_alive(spark, d):
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(Window.partitionBy("user_id").orderBy("ts"))
    return table(spark, d, "events").withColumn("gap", gap).groupBy("user_id").agg(F.count_if(F.col("gap") >= 43200).alias("keep_alives"))


@query("with t as (select user_id, min(ts) filter (event_type = 'error') as stop from events group by 1) select e.event_id from events e join t on e.user_id = t.user_id where t.stop is null or e.ts <= t.stop + interval 10 seconds")
def ST03_terminal_cleanup(spark, d):
    e = table(spark, d, "events")
    stop = F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(Window.partitionBy("user_id"))
    return e.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("ts") <= F.col("stop") + F.expr("interval 10 seconds"))).select("event_id")


@query("select user_id, count(*) filter (event_id % 5 = 2) as new_items from events group by 1")
def ST05_round_increment(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 5 == 2).alias("new_items"))


@query(None)
def ST06_token_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("seconds"))
    return state.token_bucket(e, "user_id", "seconds", 0.002)


@query("with c as (select user_id, ts, max(ts) filter (event_type = 'error') over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) as e, event_id from events) select event_id, coalesce(epoch(ts) - epoch(e) < 3600, false) as cooling from c")
def ST07_cooldown(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("ts").cast("timestamp").cast("double")
    return table(spark, d, "events").select("event_id", F.coalesce(s - F.max(F.when(F.col("event_type") == "error", s)).over(w) < 3600, F.lit(False)).alias("cooling"))


@query(None)
def ST08_cache_replay(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("seconds"))
    return state.cache_replay(e, "user_id", "seconds", 36000)


@query("select event_id, least(0.5::double * power(2, event_id % 6), 5) as delay from events")
def ST09_backoff(spark, d):
    return table(spark, d, "events").select("event_id", F.least(0.5 * F.pow(F.lit(2.0), F.col("event_id") % 6), F.lit(5.0)).alias("delay"))


@query("with l as (select user_id, list(value / 50 order by ts) as v from events group by 1) select user_id, round(list_reduce(list_prepend(1.0::double, v), lambda a, x: least(greatest(x, 0.9::double * a, 1), 4)), 6) as factor from l")
def ST10_decayed_max(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", (F.col("value") / 50).alias("v")))).alias("l")).select("user_id", F.col("l.v").alias("v"))
    return v.select("user_id", F.round(state.decayed_max("v"), 6).alias("factor"))


@query("with runs as (select user_id as task, event_type as phase, (event_id % 3)::varchar as input_version, case when event_id % 4 > 0 then 'completed' else 'failed' end as status, event_id as attempt, 'o' || event_id as output from events where event_id % 2 = 0), st as (select distinct user_id as task, event_type as phase, (event_id % 3)::varchar as input_version from events where event_id % 2 = 1) select st.task, st.phase, st.input_version, (select arg_max(output, attempt) from runs r where r.task = st.task and r.phase = st.phase and r.input_version = st.input_version and status = 'completed') is not null as skip, coalesce((select max(attempt) from runs r where r.task = st.task and r.phase = st.phase), 0) + 1 as attempt, (select arg_max(output, attempt) from runs r where r.task = st.task and r.phase = st.phase and r.input_version = st.input_version and status = 'completed') as output from st")
def ST12_stage_idempotency(spark, d):
    e = table(spark, d, "events")
    runs = e.where("event_id % 2 = 0").selectExpr("user_id as task", "event_type as phase", "cast(event_id % 3 as string) as input_version", "case when event_id % 4 > 0 then 'completed' else 'failed' end as status", "event_id as attempt", "concat('o', event_id) as output")
    st = e.where("event_id % 2 = 1").selectExpr("user_id as task", "event_type as phase", "cast(event_id % 3 as string) as input_version").distinct()
    return state.skip_completed(st, runs)


@query("select user_id, case when arg_max(event_type, ts) in ('error') then 'pending' else 'kept' end as status, least(max(event_id % 7) filter (event_type = 'purchase'), 5) as round, 5 + max(event_id % 3) as remediation_round from events group by 1")
def ST13_14_16_recovery(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.when(F.max_by("event_type", "ts").isin("error"), "pending").otherwise("kept").alias("status"), F.least(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id") % 7)), F.lit(5)).alias("round"), (5 + F.max(F.col("event_id") % 3)).alias("remediation_round"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def EXT_event_windows(spark, d):
    out = streaming.event_windows(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# Graph and lineage ---------------------------------------------------------------------------

_E = "e as (select distinct l_suppkey as a, l_partkey as b from lineitem)"


@query(f"with {_E}, g as (select b, count(*) as d from e group by 1), p as (select x.a, y.a as b, count(*) as common, sum(1 / ln(g.d)) as aa from e x join e y on x.b = y.b and x.a < y.a join g on g.b = x.b group by all), n as (select a, count(*) as n from e group by 1) select p.a, p.b, common, round(aa, 6) as adamic_adar, round(common / sqrt(na.n * nb.n), 6) as salton from p join n na on na.a = p.a join n nb on nb.a = p.b")
def GRF01_04_shared_neighbours(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return graph.shared_neighbours(e, "s", "p")


@query(f"with {_E} select count(*) as edges, count(distinct a) as sources, count(distinct b) as targets, round(count(*) / (count(distinct a) * count(distinct b)), 6) as density from e")
def GRF07_stats(spark, d):
    return graph.stats(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("with recursive p as (select p_partkey as id, case when p_partkey % 7 > 0 then p_partkey - 1 end as parent_id from part), w as (select id, id as node, 0 as depth from p union all select w.id, p.parent_id, w.depth + 1 from w join p on w.node = p.id where p.parent_id is not null) select id, arg_max(node, depth) as root, max(depth) as depth from w group by 1")
def JON13_lineage(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey as id", "case when p_partkey % 7 > 0 then p_partkey - 1 end as parent_id")
    return graph.lineage(spark, p)


# Sources, pages and reports ------------------------------------------------------------------


@query("select doc_id as id, text as title, source, 's2' as adapter, 2000 + doc_id % 20 as year, (doc_id % 90) as citation_count from documents where doc_id % 2 = 0 union all select doc_id, text, source, 'ieee', 2000 + doc_id % 20, doc_id % 90 from documents where doc_id % 2 = 1")
def SRC01_09_adapters(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id as id", "source", "text as title", "cast(2000 + doc_id % 20 as int) as y", "cast(doc_id % 90 as int) as n")
    a = t.where("id % 2 = 0").withColumn("payload", F.to_json(F.struct("title", F.col("y").alias("year"), F.col("n").alias("citationCount"))))
    b = t.where("id % 2 = 1").withColumn("payload", F.to_json(F.struct("title", F.col("y").alias("publication_year"), F.col("n").alias("citing_paper_count"))))
    both = sources.fan_out([sources.semantic_scholar(a).drop("references").withColumn("adapter", F.lit("s2")), sources.ieee(b).withColumn("adapter", F.lit("ieee"))])
    return both.join(t.select("id", "source"), "id").select("id", "title", "source", "adapter", "year", "citation_count")


@query(f"with {RANKED_SQL}, r as (select *, row_number() over (partition by query_id, source order by rank) as n from ranked where source in ('A', 'N')) select query_id, item, rank, case source when 'A' then 's2' else 'arxiv' end as source from r where n <= 2 and query_id in (select o_orderkey from orders where o_orderstatus = 'F')")
def SRC02_03_search_all(spark, d):
    """Three sources, of which one has no key and is not read; two hits a query and source."""
    r = ranked(spark, d).select("query_id", "item", "rank", "source")
    all_ = {name: r.where(F.col("source") == flag).drop("source") for name, flag in (("s2", "A"), ("arxiv", "N"), ("ieee", "R"))}
    return sources.search(table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as query_id"), sources.available(all_, {}), 2)


@query("select doc_id as id, 'On ' || source as title, 'About ' || lang as abstract, 2000 + doc_id % 25 as year, 'arXiv' as venue, '21' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '.' || lpad(doc_id::varchar, 5, '0') || 'v2' as external_id, 0 as citation_count, case when doc_id % 3 > 0 then 'http://a.org/pdf/' || doc_id else '' end as pdf_url, case when doc_id % 2 = 0 then 'http://a.org/abs/' || doc_id else 'https://arxiv.org/abs/21' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '.' || lpad(doc_id::varchar, 5, '0') || 'v2' end as url, 'A. ' || source || '|B.' as authors from documents")
def SRC05_arxiv(spark, d):
    key = "concat('21', lpad(cast(doc_id % 12 + 1 as string), 2, '0'), '.', lpad(cast(doc_id as string), 5, '0'), 'v2')"
    link = "if(doc_id % 2 = 0, concat('<link href=\"http://a.org/abs/', doc_id, '\" type=\"text/html\"/>'), '<link href=\"x\" type=\"other\"/>'), if(doc_id % 3 > 0, concat('<link title=\"pdf\" href=\"http://a.org/pdf/', doc_id, '\" type=\"application/pdf\"/>'), '<link href=\"y\"/>')"
    xml = f"concat('<entry><id>http://arxiv.org/abs/', {key}, '</id><title> On\n', source, '</title><summary>About\n', lang, ' </summary><published>', 2000 + doc_id % 25, '-05-06T00:00:00Z</published><author><name>A. ', source, '</name></author><author><name>B.</name></author>', {link}, '</entry>')"
    return sources.arxiv(table(spark, d, "documents").selectExpr("doc_id as id", f"{xml} as payload")).withColumn("authors", F.array_join("authors", "|"))


@query("select doc_id as id, case when doc_id % 7 = 0 then '' else 'On ' || source end as title, 'About ' || lang as abstract, case when doc_id % 5 > 0 then (2000 + doc_id % 25)::int end as year, case when doc_id % 3 = 0 then 'J' || (doc_id % 9) else '' end as venue, '10.1/' || doc_id as doi, '' as url, doc_id % 300 as citation_count, case when doc_id % 4 = 0 then 'Ann ' || source || '|Solo' else 'Solo' end as authors from documents")
def SRC07_crossref(spark, d):
    body = "concat('{\"DOI\": \"10.1/', doc_id, '\", \"title\": [', if(doc_id % 7 = 0, '', concat('\"On ', source, '\", \"other\"')), '], \"abstract\": \"<jats:p> About <b>', lang, '</b></jats:p>\", \"container-title\": [', if(doc_id % 3 = 0, concat('\"J', doc_id % 9, '\"'), ''), '], \"published\": {\"date-parts\": [', if(doc_id % 5 > 0, concat('[', 2000 + doc_id % 25, ', 3]'), ''), ']}, \"author\": [', if(doc_id % 4 = 0, concat('{\"given\": \"Ann\", \"family\": \"', source, '\"}, '), ''), '{\"family\": \"Solo\"}, {\"given\": \"\"}], \"is-referenced-by-count\": ', doc_id % 300, '}')"
    return sources.crossref(table(spark, d, "documents").selectExpr("doc_id as id", f"{body} as payload")).withColumn("authors", F.array_join("authors", "|"))


@query("select doc_id as id, 'On ' || source as title, '' as abstract, case doc_id % 3 when 0 then (2000 + doc_id % 25)::int end as year, '' as venue, case doc_id % 4 when 0 then '10.2/' || doc_id when 1 then '10.3/' || doc_id || '.doi' else '' end as doi, 'c' || doc_id as external_id, 0 as citation_count, case doc_id % 5 when 0 then 'http://c/' || doc_id when 1 then 'http://f/' || doc_id else '' end as pdf_url, case doc_id % 5 when 0 then 'http://c/' || doc_id when 1 then 'http://f/' || doc_id else 'c' || doc_id end as url from documents")
def SRC08_core(spark, d):
    ids = "case doc_id % 4 when 0 then concat('\"oai:1\", \"doi:10.2/', doc_id, '\"') when 1 then concat('{\"type\": \"x\", \"identifier\": \"10.3/', doc_id, '.doi\"}') when 2 then '\"oai:1\"' else '' end"
    body = f"concat('{{\"id\": \"c', doc_id, '\", \"title\": \"On ', source, '\", \"year_published\": \"', if(doc_id % 3 = 0, cast(2000 + doc_id % 25 as string), if(doc_id % 3 = 1, 'n.d.', '0')), '\", \"identifiers\": [', {ids}, '], \"download_url\": \"', if(doc_id % 5 = 0, concat('http://c/', doc_id), ''), '\", \"source_fulltext_urls\": [', if(doc_id % 5 = 1, concat('\"http://f/', doc_id, '\"'), ''), ']}}')"
    return sources.core(table(spark, d, "documents").selectExpr("doc_id as id", f"{body} as payload"))


@query("select doc_id as id, text as abstract from documents")
def SRC06_inverted_index(spark, d):
    inv = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.inverted_index(F.split("text", " ")).alias("abstract_inverted_index"))
    return sources.openalex(inv.select("id", F.to_json(F.struct("abstract_inverted_index")).alias("payload"))).select("id", "abstract")


@query(f"with {HITS_SQL} select id, coalesce(case when id % 3 = 0 then 'p' || id end, case when doi is not null and doi <> '' then 'best-' || doi end) as pdf, greatest(citation_count, id % 700) as citations from hits")
def SRC10_11_enrichment(spark, d):
    h = hits(spark, d).withColumn("doi", fn.blank_to_null("doi")).withColumn("pdf_url", F.expr("case when id % 3 = 0 then concat('p', id) else '' end"))
    loc = h.where("doi is not null").select("doi").distinct().select("doi", F.concat(F.lit("best-"), "doi").alias("best"), F.lit(None).cast("string").alias("first"))
    pdf = sources.fill_pdf(h.select("id", "doi", "pdf_url"), loc)
    more = sources.enrich(h.select("id", F.lit(0).cast("long").alias("citation_count"), F.lit("").alias("venue"), "year"), h.select("id", "citation_count", "venue", "year"), h.select("id", (F.col("id") % 700).alias("citation_count"), "venue", "year"))
    return pdf.join(more, "id").select("id", "pdf", F.col("citation_count").alias("citations"))


@query("select id, title from (select page_id as id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) as title from pages)")
def SRC13_page_text(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))


@query("select case when c.k is null then 'vector_missing' when l.k is null then 'item_missing' else 'full' end as status, count(*) as n from (select distinct doc_id as k from labels) l full join (select distinct conv_id as k from conversations) c on l.k = c.k group by 1")
def SRC19_reconcile(spark, d):
    return sources.reconcile(table(spark, d, "labels").select(F.col("doc_id").alias("k")), table(spark, d, "conversations").select(F.col("conv_id").alias("k")), "k")


@query("select doc_id, quality, 'old' as v from labels where toxic = 0 union all select doc_id, 1 - quality, 'new' from labels where toxic = 1")
def SRC17_18_replace_sink(spark, d):
    l = table(spark, d, "labels")
    return sources.replace_by_key(l.select("doc_id", "quality", F.lit("old").alias("v")), l.where("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("new").alias("v")), "doc_id")


@query("select source, '# ' || source || chr(10) || array_to_string(list('- ' || text || ' (' || lang || ')' order by n_chars desc, doc_id)[1:5], chr(10)) as markdown, count(*) as ids from documents group by 1")
def WIK03_RPT01_05_SRC21_pages(spark, d):
    line = F.concat(F.lit("- "), "text", F.lit(" ("), "lang", F.lit(")"))
    g = table(spark, d, "documents").withColumn("n", ranking.ordinal(["source"], F.desc("n_chars"), "doc_id")).groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("n") < 5, F.struct("n", line.alias("line"))))).alias("l"), F.count("*").alias("ids"))
    return g.select("source", F.concat(F.lit("# "), "source", F.lit("\n"), F.array_join("l.line", "\n")).alias("markdown"), "ids")


@query("with a as (select n_name as title, n_regionkey % 2 = 0 as concept, n_nationkey from nation), p as (select r_name as title from region union all select n_name from nation where n_nationkey % 2 = 0) select n_nationkey, case when exists (select 1 from p where p.title = a.title) then 'merge' else 'insert' end as action from a")
def WIK01_dispatch(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pages = r.select(F.col("r_name").alias("title")).union(n.where("n_nationkey % 2 = 0").select("n_name")).distinct().withColumn("found", F.lit(True))
    return n.join(pages, n["n_name"] == pages["title"], "left").select("n_nationkey", F.when(F.col("found"), "merge").otherwise("insert").alias("action"))


@query("select doc_id, case quality when 1 then 'kept: passed review' when 0 then 'dropped: quality' else 'open: not reviewed' end as explanation from documents left join labels using (doc_id)")
def RPT03_status_text(spark, d):
    t = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    texts = F.create_map(*[F.lit(x) for x in (1, "kept: passed review", 0, "dropped: quality")])
    return t.select("doc_id", F.coalesce(F.try_element_at(texts, F.col("quality")), F.lit("open: not reviewed")).alias("explanation"))


@query("select p_partkey, json_object('id', p_partkey, 'name', p_name)::varchar as json, format('{} | {} | {}', p_partkey, p_brand, p_size) as line from part")
def SRC22_RPT06_export(spark, d):
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).alias("json"), F.format_string("%d | %s | %d", "p_partkey", "p_brand", "p_size").alias("line"))
