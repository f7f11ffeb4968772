"""Admission, verdict and transition rules over aggregated evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.functions import CONTRADICTING, SUPPORTING, is_weak


def reasons(*checks: tuple[Column, str]) -> Column:
    """The texts of the checks that hold, in order."""
    return F.filter(F.array(*[F.when(when, text) for when, text in checks]), lambda x: x.isNotNull())


#: States of a question and of evidence that let it be mined, and evidence types that show a shortcoming.
ELIGIBLE, ADMISSIBLE, VERIFIED = ("open", "partially_covered", "covered"), ("verified", "upgraded", "abstract_only"), ("verified", "upgraded")
LIMITING = ("limitation", "negative_result")
#: Kinds of candidates that are supported.
GAP_TYPES = ("boundary_gap", "missing_evaluation")


def mining_admission(questions: DataFrame, links: DataFrame) -> DataFrame:
    """question_id, status, tier, reasons (array), papers, spans for each of questions(question_id, status).

    links(question_id, relevance, relation_type, paper_id, evidence_type, verification, locatable): evidence that exists.  A question that is
    not eligible fails, one without links is unknown.  Evidence that can be located in full text makes tier A, unless
    no limitation can be located; two papers with a limitation make tier B; less is a reason of its own.
    """
    strong = ~is_weak(F.coalesce("relevance", F.lit(0.0)))
    sup = strong & F.col("relation_type").isin(*SUPPORTING) & F.coalesce(F.col("verification").isin(*ADMISSIBLE), F.lit(False))
    con = strong & F.col("relation_type").isin(*CONTRADICTING) & F.coalesce(F.col("verification").isin(*VERIFIED), F.lit(False))
    limit = sup & F.col("evidence_type").isin(*LIMITING)
    by = links.groupBy("question_id").agg(
        F.count("*").alias("links"), F.countDistinct(F.when(sup, F.col("paper_id"))).alias("papers"), F.count_if(sup & F.col("locatable")).alias("spans"), F.count_if(limit).alias("limits"), F.count_if(limit & F.col("locatable")).alias("located_limits"), F.count_if(con).alias("contra")
    )
    all_ = questions.select("question_id", F.col("status").alias("state")).join(by, "question_id", "left").fillna(0, ["links", "papers", "spans", "limits", "located_limits", "contra"])
    c = F.col
    bare = (c("spans") < 1) & ~((c("papers") >= 2) & (c("limits") > 0))
    why = reasons((c("papers") < 2, "INSUFFICIENT_INDEPENDENT_PAPERS"), (c("limits") < 1, "NO_LIMITATION_SIGNAL"), (c("contra") > 0, "UNRESOLVED_VERIFIED_CONTRADICTION"), (bare, "NO_FULLTEXT_LOCATABLE_EVIDENCE"))
    out, none = ~F.coalesce(c("state").isin(*ELIGIBLE), F.lit(False)), c("links") < 1
    why = F.when(out, F.array(F.lit("QUESTION_NOT_ELIGIBLE"))).when(none, F.array(F.lit("NO_LINKED_EVIDENCE"))).otherwise(why)
    tier = F.when(out | none, "A").when((c("spans") >= 1) & ((c("limits") < 1) | (c("located_limits") > 0)), "A").otherwise("B")
    seen = lambda x: F.when(out, F.lit(0)).otherwise(c(x))
    return all_.select("question_id", F.when(out, "FAIL").when(F.size(why) == 0, "PASS").otherwise("UNKNOWN").alias("status"), tier.alias("tier"), why.alias("reasons"), seen("papers").alias("papers"), seen("spans").alias("spans"))


def validate_candidates(candidates: DataFrame, asked: DataFrame, cited: DataFrame, passed: DataFrame, offered: DataFrame) -> DataFrame:
    """candidate, reject: the first of seven reasons that holds, null where a candidate is valid.

    candidates(candidate, gap_type, contradicted boolean), asked(candidate, question_id), cited(candidate, evidence_id), passed(question_id):
    questions that are admitted, offered(evidence_id, question_id, paper_id, evidence_type): evidence of admitted questions that was shown.
    Citations that were never offered are left out, not held against the rest.
    """
    ask = asked.distinct().join(passed.select("question_id", F.lit(True).alias("ok")).distinct(), "question_id", "left")
    ask = ask.groupBy("candidate").agg(F.count("*").alias("asked"), F.count("ok").alias("known"))
    # A citation takes its candidate's questions to the evidence, whose questions it meets there as a list: no row for each pair of them.
    mine = asked.repartition("candidate").groupBy("candidate").agg(F.collect_set("question_id").alias("mine"))
    units = offered.groupBy("evidence_id").agg(F.first("paper_id").alias("paper_id"), F.first("evidence_type").alias("evidence_type"), F.collect_set("question_id").alias("of"))
    use = cited.repartition("candidate").distinct().join(mine, "candidate", "left").join(units, "evidence_id")
    use = use.select("candidate", "paper_id", F.col("evidence_type").isin(*LIMITING).alias("limits"), F.arrays_overlap("mine", "of").alias("own"))
    # Two papers are all that is asked for.
    use = use.groupBy("candidate").agg(F.count("*").alias("usable"), (F.min("paper_id") != F.max("paper_id")).cast("int").alias("more"), F.count_if("limits").alias("limits"), F.count_if("own").alias("own"))
    out = candidates.join(ask, "candidate", "left").join(use, "candidate", "left").fillna(0, ["asked", "known", "usable", "more", "limits", "own"])
    c = F.col
    rule = F.when(~F.coalesce(c("gap_type").isin(*GAP_TYPES), F.lit(False)), "UNSUPPORTED_GAP_TYPE").when((c("asked") < 1) | (c("known") < c("asked")), "UNKNOWN_QUESTION_ID").when(c("usable") < 1, "UNKNOWN_EVIDENCE_ID")
    rule = rule.when(c("own") < 1, "EVIDENCE_NOT_LINKED_TO_CITED_QUESTION").when(c("contradicted"), "UNEXPECTED_CONTRADICTING_EVIDENCE").when(c("more") < 1, "INSUFFICIENT_CANDIDATE_PAPER_SUPPORT").when(c("limits") < 1, "CANDIDATE_LACKS_LIMITATION_SIGNAL")
    return out.select("candidate", rule.alias("reject"))


def claim_verdict(coverage: DataFrame) -> DataFrame:
    """candidate_id, result, action, residual from coverage(candidate_id, claim_id, coverage): the best judgement of a claim counts, none is uncertain."""
    has = lambda x: F.bool_or(F.col("coverage") == x)
    claim = coverage.groupBy("candidate_id", "claim_id").agg(
        F.when(F.count("coverage") == 0, "UNCERTAIN").when(has("FULL"), "FULL").when(has("PARTIAL"), "PARTIAL").when(has("UNCERTAIN"), "UNCERTAIN").otherwise("NONE").alias("v")
    )
    n = lambda x: F.count_if(F.col("v") == x)
    by = claim.groupBy("candidate_id").agg(n("UNCERTAIN").alias("u"), n("NONE").alias("n"), n("PARTIAL").alias("p"), F.array_sort(F.collect_set(F.when(F.col("v").isin("NONE", "PARTIAL"), F.col("claim_id")))).alias("residual"))
    result = F.when(F.col("u") > 0, "uncertain").when((F.col("n") == 0) & (F.col("p") == 0), "closed").when(F.col("p") == 0, F.when(F.col("n") > 0, "confirmed")).otherwise("partially_closed")
    full = F.when(F.col("u") > 0, "more_search").when((F.col("n") == 0) & (F.col("p") == 0), "reject").when(F.col("p") == 0, "continue").otherwise("narrow")
    return by.select("candidate_id", result.alias("result"), full.alias("action"), "residual")


def transition(action, result) -> Column:
    a, r = F.col(action), F.col(result)
    return F.when((a == "continue") & (r == "confirmed"), "surviving").when((a == "reject") | (r == "closed"), "rejected").when((a == "narrow") | (r == "partially_closed"), "audited").otherwise("auditing")


#: Least completed queries, families and papers of a search, and the same under constrained retrieval.
SEARCH_LEAST, CONSTRAINED_LEAST = (2, 2, 3), (1, 1, 2)


def search_admission(candidates: DataFrame, queries: DataFrame, results: DataFrame, corpus: DataFrame, support: DataFrame) -> DataFrame:
    """candidate, status, reasons (array), papers, external for each of candidates(candidate, constrained boolean).

    queries(candidate, query_id, family, status), results(candidate, query_id, source, item), corpus(candidate, item): papers at hand on the same
    questions, support(candidate, item): the candidate's own.  Only the number of papers may be topped up from the corpus.
    """
    done = queries.where("status = 'completed'")
    asked = queries.groupBy("candidate").agg(F.count("*").alias("queries"), F.count_if(F.col("status") == "completed").alias("done"), F.countDistinct(F.when((F.col("status") == "completed") & (F.col("family") != ""), F.col("family"))).alias("families"))
    got = results.join(done.select("candidate", "query_id"), ["candidate", "query_id"])
    sources = got.groupBy("candidate").agg(F.countDistinct(F.when((F.col("source") != "") & (F.col("source") != "unknown"), F.col("source"))).alias("sources"))
    items = got.select("candidate", "item").unionAll(corpus.select("candidate", "item")).distinct().join(support.select("candidate", "item", F.lit(True).alias("own")).distinct(), ["candidate", "item"], "left")
    items = items.groupBy("candidate").agg(F.count("*").alias("papers"), F.count_if(F.col("own").isNull()).alias("external"))
    out = candidates.join(asked, "candidate", "left").join(sources, "candidate", "left").join(items, "candidate", "left").fillna(0, ["queries", "done", "families", "sources", "papers", "external"])
    c = F.col
    least = [F.when(c("constrained"), b).otherwise(a) for a, b in zip(SEARCH_LEAST, CONSTRAINED_LEAST, strict=True)]
    why = reasons(
        (c("done") < least[0], "INSUFFICIENT_COMPLETED_QUERIES"), (c("families") < least[1], "INSUFFICIENT_QUERY_FAMILIES"), (c("done") / F.greatest("queries", F.lit(1)) < 0.5, "SEARCH_SUCCESS_RATE_TOO_LOW"),
        (c("sources") < 1, "NO_SUCCESSFUL_SOURCE"), (c("papers") < least[2], "INSUFFICIENT_GAP_SPECIFIC_PAPERS"), (c("external") < 1, "NO_EXTERNAL_NEIGHBOR"),
    )
    none = c("queries") < 1
    why = F.when(none, F.array(F.lit("NO_GAP_QUERIES"))).otherwise(why)
    seen = lambda x: F.when(none, F.lit(0)).otherwise(c(x))
    return out.select("candidate", F.when(F.size(why) == 0, "PASS").otherwise("UNKNOWN").alias("status"), why.alias("reasons"), seen("papers").alias("papers"), seen("external").alias("external"))


def repeats(now: DataFrame, audits: DataFrame) -> DataFrame:
    """candidate, repeated for each of now(candidate, claim, neighbours array): its latest decided of audits(candidate, seq, decided, action, claim, neighbours)
    asked for more search with the same claim (an unknown one is never the same) and the same set of neighbours."""
    last = audits.where("decided").groupBy("candidate").agg(F.max_by(F.struct("action", "claim", "neighbours"), "seq").alias("p"))
    as_set = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array())))
    same = (F.col("p.action") == "more_search") & (F.col("p.claim") == F.coalesce(F.col("claim"), F.lit(""))) & (as_set(F.col("p.neighbours")) == as_set(F.col("neighbours")))
    return now.join(last, "candidate", "left").select("candidate", F.coalesce(same, F.lit(False)).alias("repeated"))


def narrowing(gaps: DataFrame, least: int = 20, most: int = 2) -> DataFrame:
    """candidate, skip (why it is not narrowed, else null), coverage (what is known to be covered then) for
    gaps(candidate, result of the latest audit, remaining, attempts, claimed, existing, summary)."""
    bare = lambda k: F.trim(F.coalesce(F.col(k), F.lit("")))
    skip = F.when(F.coalesce(F.col("result") != "partially_closed", F.lit(True)), "NO_PARTIALLY_CLOSED_AUDIT").when(F.length(bare("remaining")) < least, "NO_CONCRETE_REMAINING_DELTA")
    skip = skip.when(F.col("attempts") > most, "NARROW_ATTEMPTS_EXHAUSTED").when(bare("claimed") == bare("remaining"), "DELTA_UNCHANGED")
    merged = F.when((bare("summary") != "") & ~F.contains(bare("existing"), bare("summary")), F.trim(F.concat(bare("existing"), F.lit("\n[narrowed after audit] "), bare("summary")))).otherwise(bare("existing"))
    return gaps.select("candidate", skip.alias("skip"), F.when(skip.isNull(), F.regexp_replace(merged, r"^\s+", "")).alias("coverage"))


#: Terminal states that call for better access to a source.
SHORT_STATES = ("more_research_required", "insufficient_evidence")


def next_steps(questions: DataFrame, evidence: DataFrame, gaps: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, steps (array of what to do) for tasks(task, terminal): questions(task, question_id, question, importance, score), evidence(task, limiting), gaps(task, provenance).

    Steps: search for important questions of little coverage (the first three are named), search for limitations, upgrade partial gaps (with their
    number), add access to a source; else go on.
    """
    low = questions.where("importance >= 0.7 and (score is null or score < 0.3)").withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("question_id")))
    low = low.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", F.substring("question", 1, 40).alias("q"))))), lambda x: x["q"]), "; ").alias("names"))
    lim = evidence.where("limiting").select("task", F.lit(True).alias("lim")).distinct()
    part = gaps.where("provenance is null or provenance <> 'complete'").groupBy("task").agg(F.count("*").alias("partial"))
    out = tasks.join(low, "task", "left").join(lim, "task", "left").join(part, "task", "left")
    steps = F.filter(
        F.array(
            F.when(F.col("names").isNotNull(), F.concat(F.lit("search: "), "names")), F.when(F.col("lim").isNull(), F.lit("limitations")), F.when(F.col("partial") > 0, F.concat(F.lit("upgrade: "), F.col("partial").cast("string"))),
            F.when(F.col("terminal").isin(*SHORT_STATES), F.lit("source access")),
        ), lambda x: x.isNotNull(),
    )
    return out.select("task", F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("go on"))).alias("steps"))


#: Importance from which a question is important, and the share of those that must have a snapshot.
IMPORTANT, SEEN_SHARE = 0.7, 0.6


def readiness(tasks: DataFrame, coverage: DataFrame) -> DataFrame:
    """task, status (ready, more or failed), reason, questions, important, seen (important ones with a snapshot), covered for each of tasks(task, has_contract, active).

    coverage: task, importance, has_snapshot, score, unavailable, evidence, a row a question.  Only important questions count for snapshots and coverage; one
    whose evidence is known to be unavailable counts as covered, and where no question is important both hold.
    """
    high = F.coalesce("importance", F.lit(0.0)) >= IMPORTANT
    seen = high & F.col("has_snapshot")
    counts = coverage.groupBy("task").agg(
        F.count("*").alias("questions"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"), F.count_if(high).alias("important"), F.count_if(seen).alias("seen"), F.count_if(seen & ((F.col("score") > 0) | F.col("unavailable"))).alias("covered"),
    )
    t = tasks.join(counts, "task", "left").na.fill(0, ["questions", "evidence", "important", "seen", "covered"])
    missing = F.col("important") > F.col("seen")
    checks = [
        (~F.coalesce("has_contract", F.lit(False)), "failed", "no contract"), (~F.coalesce("active", F.lit(False)), "failed", "contract not active"), (F.col("questions") == 0, "failed", "no questions"), (F.col("evidence") == 0, "failed", "no evidence"),
        (missing & (F.col("seen") == 0), "failed", "no snapshot of an important question"), (missing & (F.col("seen") / F.col("important") < SEEN_SHARE), "more", "snapshots"), ((F.col("important") > 0) & (F.col("covered") == 0), "more", "coverage"),
    ]
    verdict = F.struct(F.lit("ready").alias("status"), F.lit("").alias("reason"))
    for found, status, reason in reversed(checks):
        verdict = F.when(found, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return t.withColumn("v", verdict).select("task", "v.status", "v.reason", "questions", "important", "seen", "covered")
