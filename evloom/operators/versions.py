"""Versions of a run's stages: what each has read, and through the stages before it what those have read.

A stage's own version is the SHA-256 of its inputs as JSON with sorted keys.  Its version also covers the versions of the stages it builds on, so
one changed input changes that stage and all after it, and no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of each stage, in order, its inputs and the stages it builds on.
STAGES = {
    "clarify": (("clarification_questions", "pipeline_version", "user_input"), ()),
    "search": (("active_question_ids", "contract_input_hash", "pipeline_version", "previous_coverage_version", "round_number"), ("clarify",)),
    "evidence": (("active_question_ids", "pipeline_version", "round_number", "round_paper_ids"), ("search",)),
    "coverage": (("active_question_ids", "evidence_hashes", "pipeline_version", "round_evidence_ids", "round_number"), ("evidence",)),
    "summarize": (("new_papers", "papers_found", "round_number", "scored_count"), ("search",)),
    "mining": (("contract_id", "evidence_fingerprint", "gap_mining_policy_version", "pipeline_version", "round_number"), ("coverage",)),
    "audit": (("audited_gap_ids", "gap_claims", "gap_ids", "gap_mining_policy_version", "gap_search_policy_version", "pipeline_version", "round_number"), ("mining",)),
    "phenomenon": (("contract_id", "pipeline_version", "surviving_gap_ids"), ("audit",)),
    "intervention": (("contract_id", "gap_mining_policy_version", "pipeline_version", "surviving_gap_ids"), ("audit",)),
    "experiment": (("contract_id", "gap_mining_policy_version", "intervention_ids", "pipeline_version"), ("intervention",)),
}
#: Inputs that are sets: their order doesn't count.
SETS = {"active_question_ids", "round_paper_ids", "evidence_hashes", "round_evidence_ids", "audited_gap_ids", "gap_ids", "surviving_gap_ids", "intervention_ids", "gap_claims"}


def stage_versions(runs: DataFrame, *key: str) -> DataFrame:
    """key, stage, own, version for each run and stage. runs: one row a run with a column for each input; sets are arrays (null counts as empty), gap_claims an array of (gap, claim)."""
    value = lambda c: F.array_sort(F.coalesce(F.col(c), F.array())) if c in SETS else F.col(c)
    own = {s: F.sha2(F.to_json(F.struct(*(value(c).alias(c) for c in sorted(fields))), {"ignoreNullFields": "false"}), 256) for s, (fields, _) in STAGES.items()}
    df = runs.select(*key, *(x.alias(f"own_{s}") for s, x in own.items()))
    # One column after the other, since a stage only builds on earlier ones: no join, one row a run.
    df = reduce(lambda d, s: d.withColumn(f"version_{s}", F.sha2(F.concat_ws(",", f"own_{s}", *(f"version_{p}" for p in STAGES[s][1])), 256)), STAGES, df)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"own_{s}").alias("own"), F.col(f"version_{s}").alias("version")) for s in STAGES)))
    return df.select(*key, rows.alias("x")).select(*key, "x.*")


def invalidated(before: DataFrame, now: DataFrame, *key: str) -> DataFrame:
    """key, stage, why of the stages to run again: new (not run before), changed (own inputs) or inherited (only a stage before it changed)."""
    old = before.select(*key, "stage", F.col("own").alias("own_before"), F.col("version").alias("version_before"))
    both = now.join(old, [*key, "stage"], "left").where("version_before is null or version != version_before")
    return both.select(*key, "stage", F.when(F.col("version_before").isNull(), "new").when(F.col("own") != F.col("own_before"), "changed").otherwise("inherited").alias("why"))
