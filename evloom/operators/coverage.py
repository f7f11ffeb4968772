"""Coverage of questions by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.functions import CONTRADICTING, SUPPORTING, coverage_score, is_weak


def tallies(links: DataFrame) -> DataFrame:
    """A row for each question with links: strong supporting and contradicting ones and their papers, weak ones as background."""
    strong = ~is_weak("relevance")
    sup, con = strong & F.col("relation_type").isin(*SUPPORTING), strong & F.col("relation_type").isin(*CONTRADICTING)
    papers = lambda x: F.countDistinct(F.when(x, F.col("paper_id")))
    return links.groupBy("question_id").agg(F.count_if(sup).alias("supporting"), F.count_if(con).alias("contradicting"), F.count_if(~strong).alias("background"), papers(sup).alias("s_papers"), papers(con).alias("c_papers"))


def matrix(links: DataFrame, questions: DataFrame) -> DataFrame:
    """The tallies of each of questions(question_id), zeros where there are no links, with coverage, status and confidence."""
    by = questions.select("question_id").distinct().join(tallies(links), "question_id", "left").na.fill(0, ["supporting", "contradicting", "background", "s_papers", "c_papers"])
    n = F.col("supporting") + F.col("contradicting") + F.col("background")
    score = F.when(n > 0, coverage_score(n, "s_papers", "c_papers")).otherwise(0.0)
    status = F.when(score >= 0.7, "covered").when(score >= 0.3, "partially_covered").otherwise("open")
    return by.select("*", F.bround(score, 2).alias("coverage"), status.alias("status"), F.least(F.lit(1.0), 0.15 * n).alias("confidence"))


#: Evidence types that answer a question of each type, the relation that an evidence type has to it (supports if not named), and the relevance of such a match.
ANSWERS = {
    "problem": ("problem", "limitation", "negative_result"),
    "method": ("method", "comparison"),
    "evaluation": ("result", "metric", "comparison"),
    "dataset": ("dataset", "result"),
    "resource": ("result", "limitation"),
    "failure": ("negative_result", "limitation"),
    "application": ("result", "future_work"),
}
RELATIONS = {"negative_result": "contradicts", "limitation": "partially_answers", "future_work": "background", "comparison": "background"}
MATCHED = 0.5


def heuristic_match(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, evidence_id, relation, relevance: questions(question_id, question_type) with the evidence(question_id, evidence_id, evidence_type) offered to them whose type answers theirs."""
    kinds = questions.sparkSession.createDataFrame([(q, e) for q, es in ANSWERS.items() for e in es], "question_type string, evidence_type string")
    found = evidence.join(questions.select("question_id", "question_type"), "question_id").join(F.broadcast(kinds), ["question_type", "evidence_type"])
    relation = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv]), "evidence_type"), F.lit("supports"))
    return found.select("question_id", "evidence_id", relation.alias("relation"), F.lit(MATCHED).alias("relevance"))


def quality(links: DataFrame) -> DataFrame:
    """Evidence quality of each question's supporting links, of two digits: full text, directness, breadth and confidence; with the first two by themselves. Zeros where there are none."""
    sup = links.where((~is_weak("relevance")) & F.col("relation_type").isin(*SUPPORTING))
    by = sup.groupBy("question_id").agg(
        F.avg(F.col("fulltext").cast("double")).alias("f"), F.avg((F.col("relation_type") == "supports").cast("double")).alias("d"), F.countDistinct("paper_id").alias("s"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("m")
    )
    value = 0.4 * F.col("f") + 0.25 * F.col("d") + 0.2 * F.least(F.lit(1.0), F.col("s") / 3) + 0.15 * F.col("m")
    digits = lambda x: F.coalesce(F.bround(x, 2), F.lit(0.0))
    return links.select("question_id").distinct().join(by, "question_id", "left").select("question_id", digits(value).alias("quality"), digits(F.col("f")).alias("fulltext_ratio"), digits(F.col("d")).alias("directness"))


def saturation(rounds: DataFrame, papers: DataFrame, evidence: DataFrame, top: int = 5) -> DataFrame:
    """State, marginal papers and evidence, and stability for each of rounds(question_id, round).

    papers(question_id, paper_id, priority, round, score): those that support the question, by the round that found them; only high and
    medium ones count.  evidence(question_id, paper_id, round): units of these papers; papers with units count, once a round.
    Gains relate to what was there before the round.  The best `top` of all rounds up to this one are held against those of all up to the last.
    """
    good = papers.where(F.col("priority").isin("high", "medium")).select("question_id", F.col("round").alias("r"), "paper_id", "score")
    k = ["question_id", "round"]
    upto = rounds.join(good, "question_id").where("r <= round")
    counts = upto.groupBy(*k).agg(F.count_if(F.col("r") == F.col("round")).alias("new_papers"), F.count("*").alias("papers"))
    units = rounds.join(evidence.select("question_id", F.col("round").alias("r"), "paper_id"), "question_id").where("r <= round")
    seen = units.groupBy(*k).agg(F.countDistinct(F.when(F.col("r") == F.col("round"), F.col("paper_id"))).alias("new_evidence"), F.countDistinct("paper_id").alias("evidence"))
    # The round before as a round of its own: the best up to it.
    both = rounds.select(*k).unionAll(rounds.select("question_id", F.col("round") - 1)).distinct()
    place = F.row_number().over(Window.partitionBy(*k).orderBy(F.desc_nulls_last("score"), "paper_id"))
    best = both.join(good, "question_id").where("r <= round").withColumn("place", place).where(F.col("place") <= top).groupBy(*k).agg(F.collect_list("paper_id").alias("top"))
    before = best.select("question_id", (F.col("round") + 1).alias("round"), F.col("top").alias("old"))
    out = rounds.select(*k).join(counts, k, "left").join(seen, k, "left").join(best, k, "left").join(before, k, "left").join(papers.select("question_id").distinct().withColumn("any", F.lit(True)), "question_id", "left")
    out = out.fillna(0, ["new_papers", "papers", "new_evidence", "evidence"])
    stable = F.coalesce(F.size(F.array_intersect("top", "old")) / F.lit(float(top)), F.lit(0.0))
    gain = lambda new, every: F.col(new) / F.greatest(F.lit(1), F.col(every) - F.col(new))
    few = (F.col("new_papers") < 2) & (F.col("new_evidence") < 3)
    slow = (gain("new_papers", "papers") < 1.0) & (gain("new_evidence", "evidence") < 1.0)
    state = F.when(F.col("any").isNull() | (F.col("round") < 2), "INSUFFICIENT_OBSERVATION").when(few & slow & (stable >= 0.6), "SATURATED").otherwise("STILL_GAINING")
    return out.select(*k, state.alias("state"), "new_papers", "new_evidence", stable.alias("stability"))


#: Pairs that one task makes or tells apart, about.
PAIRS = 1_000_000


def neighbours(asked: DataFrame, members: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    """c, p: members (by, p) of the groups that a candidate asks for (by, c), each once, but for its own (c, p).

    Pairs are counted first, and tasks follow their number, so that the memory of one does not grow with the tables.
    """
    sizes = asked.groupBy(*by).agg(F.count("*").alias("n")).join(members.groupBy(*by).agg(F.count("*").alias("k")), by)
    tasks = max(1, (sizes.agg(F.sum(F.col("n") * F.col("k"))).first()[0] or 0) // PAIRS)
    tasks = max(tasks, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = asked.repartition(tasks, *by).join(members.repartition(tasks, *by).hint("merge"), by).select("c", "p")
    found = met.repartition(tasks, "c", "p").distinct()
    return found.join(own.repartition(tasks, "c", "p").hint("merge"), ["c", "p"], "left_anti")
