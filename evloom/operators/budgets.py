"""Whether another directed search may be run, from a ledger of the rounds that were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reasons for a directed search, by their keys, and the one that is charged to families of gaps; rounds allowed for a reason, a task and a family.
REASONS = ("readiness_more_research", "no_evidence_backed_gap_candidates", "no_surviving_gap_after_audit", "no_intervention_passed_hard_gates")
OF_FAMILIES = "no_surviving_gap_after_audit"
A_REASON, A_TASK, A_FAMILY = 2, 3, 2


def may_search(requests: DataFrame, ledger: DataFrame, a_reason: int = A_REASON, a_task: int = A_TASK, a_family: int = A_FAMILY) -> DataFrame:
    """task, reason, key, allowed, refused, families_left for each distinct (task, reason) of requests.

    requests: task, reason, family (of the gaps served; null for none), one row a family.  A reason counts by the key that it begins with.  ledger: task, key, family, one row for each
    round and family that it served, and round, which numbers a task's rounds.  refused: disabled, unknown reason, task budget, no family, family budget or reason budget, the first that
    holds; families_left: families that still have rounds.  Rounds of other families don't count against one.
    """
    key = F.coalesce(*(F.when(F.col("reason").startswith(k), k) for k in REASONS))
    asked = requests.select("task", "reason", "family", key.alias("key")).distinct()
    total = ledger.groupBy("task").agg(F.countDistinct("round").alias("total"))
    by_key = ledger.groupBy("task", "key").agg(F.countDistinct("round").alias("of_key"))
    by_family = ledger.where(F.col("family").isNotNull()).groupBy("task", "family").agg(F.countDistinct("round").alias("used"))
    served = asked.join(by_family, ["task", "family"], "left").groupBy("task", "reason", "key")
    served = served.agg(F.count("family").alias("families"), F.count_if(F.col("family").isNotNull() & (F.coalesce("used", F.lit(0)) < a_family)).alias("families_left"))
    df = served.join(total, "task", "left").join(by_key, ["task", "key"], "left").na.fill(0, ["total", "of_key"])
    gaps = F.col("key") == OF_FAMILIES
    refused = (
        F.when(F.lit(a_reason <= 0), "disabled").when(F.col("key").isNull(), "unknown reason").when(F.col("total") >= a_task, "task budget").when(gaps & (F.col("families") == 0), "no family")
        .when(gaps & (F.col("families_left") == 0), "family budget").when(~gaps & (F.col("of_key") >= a_reason), "reason budget")
    )
    return df.select("task", "reason", "key", refused.isNull().alias("allowed"), refused.alias("refused"), "families_left")
