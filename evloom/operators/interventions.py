"""Hard gates of interventions: evidence, novelty and feasibility under a contract, and the tier that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.operators.ranking import heads

#: Words that tell of training, of large and of small benchmarks, of any benchmark, and of what needs a GPU; evidence that a gap needs.
TRAINING = ("fine-tune", "finetune", "fine tune", "training", "train ", "训练", "微调")
LARGE = ("large benchmark", "large-scale", "large scale", "large dataset", "大型", "大规模", "超大")
SMALL = ("micro-benchmark", "micro benchmark", "microbenchmark", "small benchmark", "small-scale", "small scale", "benchmarking protocol", "controlled benchmark", "微基准", "小规模", "受控", "单机", "single-gpu")
BENCHMARK, GPU = ("benchmark", "基准"), ("gpu", "train", "fine-tune", "训练", "微调")
LEAST_EVIDENCE = 2


def _names(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in a lower-case text; one alternation, so the text is read once."""
    return text.rlike("|".join(words))


def feasibility(core: Column, cost: Column) -> Column:
    """PASS, WARN or FAIL of an intervention's texts under allow_training, allow_large_benchmark and gpu_available (null: not said, so allowed)."""
    core, cost = F.lower(F.coalesce(core, F.lit(""))), F.lower(F.coalesce(cost, F.lit("")))
    both = F.concat_ws(" ", core, cost)
    forbids = lambda c: F.coalesce(~F.col(c), F.lit(False))
    no_gpu, small = forbids("gpu_available"), _names(both, SMALL)
    training = F.when(_names(core, TRAINING) & no_gpu, "FAIL").otherwise("WARN")
    benchmark = F.when(small, "PASS").when(_names(both, LARGE), "FAIL").otherwise("WARN")
    return (
        F.when(forbids("allow_training") & _names(both, TRAINING), training).when(forbids("allow_large_benchmark") & _names(both, BENCHMARK), benchmark)
        .when(no_gpu & _names(core, GPU), "WARN").otherwise("PASS")
    )


def hard_gates(interventions: DataFrame, gaps: DataFrame, evidence: DataFrame, audits: DataFrame, contracts: DataFrame) -> DataFrame:
    """intervention_id, evidence, novelty, feasible and tier (A, B or C).

    interventions: intervention_id, gap_id, core, cost.  gaps: gap_id, contract_id, complete.  evidence: gap_id, evidence_id.  audits: gap_id, created, result, remaining; the
    last counts.  contracts: contract_id, allow_training, allow_large_benchmark, gpu_available.  A gap without evidence or audits fails or is unknown there; one without a contract is free.
    """
    backed = evidence.groupBy("gap_id").agg(F.countDistinct("evidence_id").alias("n"))
    last = heads(audits, "gap_id", "created", "result").select("gap_id", "result", F.coalesce("remaining", F.lit("")).alias("remaining"))
    df = interventions.join(gaps, "gap_id").join(backed, "gap_id", "left").join(last, "gap_id", "left").join(contracts, "contract_id", "left")
    novelty = F.when((F.col("result") == "confirmed") & (F.col("remaining") != ""), "PASS").when(F.col("result") == "closed", "FAIL").otherwise("UNKNOWN")
    df = df.select("intervention_id", "complete", F.when(F.col("n") >= LEAST_EVIDENCE, "PASS").otherwise("FAIL").alias("evidence"), novelty.alias("novelty"), feasibility(F.col("core"), F.col("cost")).alias("feasible"))
    gates = F.array("evidence", "novelty", "feasible")
    tier = F.when(F.array_contains(gates, "FAIL"), "C").when(F.forall(gates, lambda g: g == "PASS") & F.coalesce("complete", F.lit(False)), "A").otherwise("B")
    return df.select("intervention_id", "evidence", "novelty", "feasible", tier.alias("tier"))
