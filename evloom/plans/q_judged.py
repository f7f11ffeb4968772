"""Judgements with retry and fallback, and stage versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.operators import judgements, versions
from evloom.plans.base import RANK_ORDER, query, table
from evloom.plans.q_domain import _ANSWERS, _ETYPE, _QTYPE

_GOOD = '{"matches": [{"index": 1, "relation": "supports", "relevance": 0.9}, {"index": 3, "relation": "odd", "relevance": 0.25}, {"index": 99, "relation": "background"}]}'
_BAD = '{"matches": [{"index": 1, "relevance": 1.5}]}'


def _provider(asked):
    """Answers made from the request: some cut off, out of range or missing, some of those right when asked again."""
    m = (F.col("question_id") * 7 + F.col("batch")) % 5
    raw = F.when(m >= 3, _GOOD).when(m == 1, _BAD).when((m == 0) & (F.col("attempt") == 1), _GOOD[:40]).when(m == 0, _GOOD)
    return asked.select("question_id", "batch", raw.alias("raw"))


_EVIDENCE = f"l_orderkey * 100 + row_number() over (partition by l_orderkey order by {', '.join(RANK_ORDER)})"
_BATCHED = f"""m as (select l_suppkey as q, {_EVIDENCE} as ev, {_ETYPE} as e, {_QTYPE} as t from lineitem join supplier on l_suppkey = s_suppkey),
n as (select *, row_number() over (partition by q order by ev) - 1 as n from m), b as (select *, n % 40 + 1 as i, (q * 7 + n // 40) % 5 as how from n)"""
_FALLBACK = "case e when 'negative_result' then 'contradicts' when 'limitation' then 'partially_answers' when 'future_work' then 'background' when 'comparison' then 'background' else 'supports' end"


@query(f"""with {_BATCHED} select q as question_id, ev as evidence_id, 'supports' as relation, case i when 1 then 0.9 else 0.25 end::double as relevance, case how when 0 then 'retried' else 'judged' end as via from b where how in (0, 3, 4) and i in (1, 3)
union all select q, ev, {_FALLBACK}, 0.5::double, 'fallback' from b where how in (1, 2) and ({_ANSWERS})""")
def JDG01_matching(spark, d):
    """Suppliers as questions, their lines of orders as evidence, 40 a request."""
    q = table(spark, d, "supplier").selectExpr("s_suppkey as question_id", "s_name as question", f"{_QTYPE} as question_type")
    e = table(spark, d, "lineitem").selectExpr("l_suppkey as question_id", f"{_EVIDENCE} as evidence_id", f"{_ETYPE} as evidence_type", "l_returnflag as claim")
    return judgements.match(q, e, _provider)


#: Customers as runs: two runs each, the second with some inputs changed.
def _run(v: int) -> list[str]:
    return [
        "c_custkey as run", "cast(c_nationkey as string) as user_input", "'v1' as pipeline_version", "array('a', 'b') as clarification_questions", f"concat('h', c_custkey % {3 + v}) as contract_input_hash", "array(c_nationkey, 1L) as active_question_ids",
        "cast(null as string) as previous_coverage_version", "1 as round_number", f"array(c_custkey % 5, {v} * (c_custkey % 2)) as round_paper_ids", "array('x') as evidence_hashes", "array(c_custkey) as round_evidence_ids", "3L as new_papers", "7L as papers_found",
        f"c_custkey % 4 * {v} as scored_count", "c_custkey as contract_id", "'f' as evidence_fingerprint", "'g1' as gap_mining_policy_version", "'s1' as gap_search_policy_version", "array(1L) as audited_gap_ids", "array(1L, 2L) as gap_ids", f"array(struct(1L as gap, concat('c', c_custkey % {v}) as claim)) as gap_claims",
        "array(2L, 1L) as surviving_gap_ids", f"array(c_custkey % {v + 5}) as intervention_ids",
    ]


_CHANGED = """x as (select c_custkey as run, c_custkey % 4 <> c_custkey % 5 as search, c_custkey % 2 = 1 as evidence, c_custkey % 4 <> 0 as summary, c_custkey % 2 = 1 as audit, c_custkey % 6 <> c_custkey % 7 as experiment from customer),
s as (select run, unnest([
  {'stage': 'search', 'own': search, 'up': false}, {'stage': 'evidence', 'own': evidence, 'up': search}, {'stage': 'coverage', 'own': false, 'up': search or evidence}, {'stage': 'summarize', 'own': summary, 'up': search}, {'stage': 'mining', 'own': false, 'up': search or evidence},
  {'stage': 'audit', 'own': audit, 'up': search or evidence}, {'stage': 'phenomenon', 'own': false, 'up': search or evidence or audit}, {'stage': 'intervention', 'own': false, 'up': search or evidence or audit}, {'stage': 'experiment', 'own': experiment, 'up': search or evidence or audit}]) as x from x)"""


@query(f"with {_CHANGED} select run, x.stage as stage, case when x.own then 'changed' else 'inherited' end as why from s where x.own or x.up")
def HSH04_stage_invalidation(spark, d):
    """Stages to run again when a run's search, evidence, summary, audit or experiment inputs change."""
    c = table(spark, d, "customer")
    before, now = (versions.stage_versions(c.selectExpr(*_run(v)), "run") for v in (1, 2))
    return versions.invalidated(before, now, "run")
