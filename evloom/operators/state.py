"""Stateful folds over ordered events: token bucket, cache replay, decayed maximum, bounded queues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(events: DataFrame, key: str, order: str, most: int = 200) -> DataFrame:
    """The batch form of a bounded queue that drops the oldest."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def token_bucket(events: DataFrame, key: str, seconds: str, per_minute: float) -> DataFrame:
    """key, seconds, tokens (after the request, may be negative), wait: refills at per_minute / 60, holds 1.5 x the rate at most.

    The state depends on each event before it: a key's events are folded in order, as a stream would.
    """
    rate, room = per_minute / 60, float(int(1.5 * per_minute))

    def fold(d: pd.DataFrame) -> pd.DataFrame:
        d, level, last, out = d.sort_values(seconds, kind="stable"), room, None, []
        for t in d[seconds]:
            level = min(room, level + (0 if last is None else (t - last) * rate)) - 1
            last = t
            out.append(level)
        return pd.DataFrame({key: d[key], seconds: d[seconds], "tokens": out, "wait": [max(0.0, -x / rate) for x in out]})

    kinds = dict(events.dtypes)
    return events.select(key, seconds).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {seconds} {kinds[seconds]}, tokens double, wait double")


def cache_replay(requests: DataFrame, key: str, seconds: str, ttl: float) -> DataFrame:
    """hit: the key was inserted less than ttl before. An entry's age counts from its insertion, so inserts are folded in order."""
    w = Window.partitionBy(key).orderBy(seconds)
    rows = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.col(seconds).cast("double"))).alias("t"))
    start = "named_struct('last', cast(null as double), 'out', cast(array() as array<struct<t:double,hit:boolean>>))"
    step = f"(a, x) -> if(coalesce(x - a.last < {float(ttl)}D, false), named_struct('last', a.last, 'out', concat(a.out, array(named_struct('t', x, 'hit', true)))), named_struct('last', x, 'out', concat(a.out, array(named_struct('t', x, 'hit', false)))))"
    del w
    return rows.select(key, F.expr(f"aggregate(t, {start}, {step}, a -> a.out)").alias("o")).select(key, F.explode("o").alias("x")).select(key, F.col("x.t").alias(seconds), "x.hit")


def decayed_max(values: str, decay: float = 0.9, lo: float = 1.0, hi: float = 4.0):
    """Folds an ordered array: min(max(observed, decay x previous, lo), hi)."""
    return F.expr(f"aggregate({values}, {lo}D, (a, x) -> least(greatest(x, {decay}D * a, {lo}D), {hi}D))")


def skip_completed(stages: DataFrame, runs: DataFrame) -> DataFrame:
    """stages(task, phase, input_version) with skip, attempt and output from runs(task, phase, input_version, status, attempt, output)."""
    done = runs.where("status = 'completed' and input_version <> ''").groupBy("task", "phase", "input_version").agg(F.max_by("output", "attempt").alias("output"))
    tries = runs.groupBy("task", "phase").agg(F.max("attempt").alias("last"))
    out = stages.join(done, ["task", "phase", "input_version"], "left").join(tries, ["task", "phase"], "left")
    return out.select("task", "phase", "input_version", F.col("output").isNotNull().alias("skip"), (F.coalesce("last", F.lit(0)) + 1).alias("attempt"), "output")


def run_rounds(step, first: int, last: int, retries: int = 3, failures: int = 5, same: int = 3) -> list[tuple[int, str]]:
    """Calls step(round) for each round in turn, again where it raises; gives (round, done or failed).

    A round is tried `retries` times. All stop with `failures` failed rounds, or once `same` equal errors follow each
    other. Each round is its own set of jobs, so a restart goes on with the round after the last finished one.
    """
    out, streak, before = [], 0, None
    for n in range(first, last + 1):
        for _ in range(retries):
            try:
                step(n)
            except Exception as e:  # noqa: BLE001 - any error counts against the budget
                streak, before = (streak + 1 if str(e) == before else 1), str(e)
                if streak >= same:
                    return [*out, (n, "failed")]
            else:
                out.append((n, "done"))
                streak, before = 0, None
                break
        else:
            out.append((n, "failed"))
            if sum(s == "failed" for _, s in out) >= failures:
                break
    return out


def pool_fingerprint(evidence: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """by, version: SHA-256 over the rows of evidence(by, id, paper_id, type, status, confidence) and links(by, question_id, id, relation, relevance), numbers to three digits.

    Rows are hashed one by one and their hashes added, so the order does not matter and no group is collected; a
    row more, less or changed gives another version.
    """
    num = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    row = lambda tag, *cs: F.sha2(F.concat_ws("\x1f", F.lit(tag), *[F.coalesce(c.cast("string"), F.lit("")) for c in cs]), 256).alias("h")
    e = evidence.select(by, row("e", *map(F.col, ("id", "paper_id", "type", "status")), num(F.col("confidence"))))
    l = links.select(by, row("l", *map(F.col, ("question_id", "id", "relation")), num(F.col("relevance"))))
    part = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(5)]
    return e.unionAll(l).groupBy(by).agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *part), 256).alias("version"))


def contract_version(tasks: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """key, version: SHA-256 of the inputs of a contract: tasks(key, task_input, state_input, state_feedback, pipeline_version) and feedback(key, seq, kind, content), in order.

    Texts are stripped, nulls are empty; questions that were derived from these inputs are no part of it.
    """
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))))), lambda x: x["c"])
    told = feedback.groupBy(key).agg(of("clarification_answer").alias("a"), of("research_feedback").alias("r"))
    none = F.array().cast("array<string>")
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    parts = F.struct(
        F.coalesce("a", none).alias("clarification_answers"), F.col("pipeline_version"), F.coalesce("r", none).alias("research_feedbacks"), bare("state_feedback").alias("state_user_feedback"), bare("state_input").alias("state_user_input"), bare("task_input").alias("task_user_input")
    )
    return tasks.join(told, key, "left").select(key, F.sha2(F.to_json(parts), 256).alias("version"))


def round_outcomes(attempts: DataFrame, task: str, tries: int = 3, budget: int = 5, streak: int = 3) -> DataFrame:
    """task, completed, failed, stopped (null, failed_budget or identical_error) from attempts(task, round, seq, ok, error).

    A round takes attempts until one succeeds, `tries` at most, else it fails.  A task stops with the attempt that makes `budget` rounds fail or
    gives the same error `streak` times in a row; what comes later is not counted.
    """
    by = Window.partitionBy(task, "round").orderBy("seq")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    a = attempts.withColumns({"_n": F.row_number().over(by), "_won": F.coalesce(F.bool_or("ok").over(before), F.lit(False))}).where(~F.col("_won") & (F.col("_n") <= tries))
    a = a.withColumn("_end", F.when(F.col("ok"), 1).when(F.col("_n") == tries, -1).otherwise(0))
    line = Window.partitionBy(task).orderBy("seq")
    change = (F.lag("error").over(line).isNull() | (F.lag("error").over(line) != F.col("error")) | F.col("ok")).cast("int")
    a = a.withColumn("_run", F.sum(change).over(line)).withColumn("_failed", F.sum((F.col("_end") == -1).cast("int")).over(line))
    a = a.withColumn("_same", F.when(~F.col("ok"), F.row_number().over(Window.partitionBy(task, "_run").orderBy("seq"))))
    why = F.when(F.col("_same") >= streak, "identical_error").when(F.col("_failed") >= budget, "failed_budget")
    a = a.withColumn("_why", why).withColumn("_stop", F.min(F.when(F.col("_why").isNotNull(), F.col("seq"))).over(Window.partitionBy(task)))
    a = a.where("_stop is null or seq <= _stop")
    return a.groupBy(task).agg(F.count_if(F.col("_end") == 1).alias("completed"), F.count_if(F.col("_end") == -1).alias("failed"), F.max(F.when(F.col("seq") == F.col("_stop"), F.col("_why"))).alias("stopped"))
