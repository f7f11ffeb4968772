"""Scores of ideas with their penalties, and queries that may be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom import functions as fn

#: What novelty loses if something alike was found or nothing could be searched; per finding and at most, what unknown metrics, made-up
#: baselines and those found after enrichment cost; and the scores from which an idea goes on or is revised.
KNOWN, UNSEARCHED = 0.1, 0.05
PENALTIES = {"metrics": (0.05, 0.15), "fabricated": (0.08, 0.2), "enriched": (0.1, 0.2)}
GO, REVISE = 0.7, 0.5
#: Fixed value: valid queries that a round needs, if it asks for as many.
LEAST = 3


def score_ideas(ideas: DataFrame) -> DataFrame:
    """ideas with penalty, score and decision. novel: null where the search failed; metrics, fabricated, enriched: findings of each check.

    Only a score that a check has lowered is kept from falling below 0.
    """
    loss = F.when(F.col("novel").isNull(), UNSEARCHED).when(F.col("novel"), 0.0).otherwise(KNOWN)
    penalty = sum((F.least(F.lit(most), F.lit(each) * F.coalesce(F.col(c), F.lit(0))) for c, (each, most) in PENALTIES.items()), F.lit(0.0))
    kept = F.col("novelty")
    df = ideas.withColumn("_novelty", kept).withColumn("novelty", F.greatest(F.lit(0.0), kept - loss)).withColumn("penalty", F.round(penalty, 9)).withColumn("score", F.round(fn.idea_score(), 9))
    df = df.withColumn("novelty", F.col("_novelty")).drop("_novelty").withColumn("score", F.when(F.col("penalty") > 0, F.greatest(F.lit(0.0), F.round(F.col("score") - F.col("penalty"), 9))).otherwise(F.col("score")))
    return df.withColumn("decision", F.when(F.col("score") >= GO, "go").when(F.col("score") >= REVISE, "revise").otherwise("reject"))


def valid_queries(generated: DataFrame, questions: DataFrame, most: int) -> DataFrame:
    """task, status, queries (array of (text, question_id) in order) for each task of generated(task, attempt, place, text, question_id).

    A query counts if its question is one of questions(task, question_id) and its normalised text is new.  The second attempt counts only where the first gave
    fewer than min(3, most); a task that still has fewer is `failed` and sends none; others send the first `most`.
    """
    least = min(LEAST, most)
    good = generated.join(questions.select("task", "question_id").distinct(), ["task", "question_id"], "left_semi").withColumn("norm", fn.normalise_query("text"))
    once = good.groupBy("task", "norm").agg(F.min(F.struct("attempt", "place", "text", "question_id")).alias("q")).select("task", "q.*")
    by = once.groupBy("task").agg(F.count_if(F.col("attempt") == 1).alias("first"), F.array_sort(F.collect_list(F.struct("attempt", "place", "text", "question_id"))).alias("l"))
    sent = F.when(F.col("first") >= least, F.filter("l", lambda x: x["attempt"] == 1)).otherwise(F.col("l"))
    by = generated.select("task").distinct().join(by, "task", "left").withColumn("l", F.coalesce(sent, F.slice(F.array(F.struct(F.lit(1).alias("attempt"), F.lit(1).alias("place"), F.lit("").alias("text"), F.lit(None).cast(dict(generated.dtypes)["question_id"]).alias("question_id"))), 1, 0)))
    ok = F.size("l") >= least
    return by.select("task", F.when(ok, "sent").otherwise("failed").alias("status"), F.when(ok, F.transform(F.slice("l", 1, most), lambda x: F.struct(x["text"].alias("text"), x["question_id"].alias("question_id")))).alias("queries"))
