"""Judgements by a model or a person, as rows in and validated rows out.

A provider is a function from requests (request columns, prompt, attempt, error) to answers (request columns, raw), where raw is JSON text: a join with
a table of answers, or a mapInPandas that calls a service.  Answers are read permissively, checked by the kind's rule, and written after each attempt; only
requests without a valid answer, found by anti-join with that table, are asked again, with what was wrong.  What is still open after the last attempt goes to the declared fallback.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.operators import coverage
from evloom.operators.shared import cut

ATTEMPTS = 2
#: Evidence of one request, characters of a claim that it shows, and relations that an answer may name (others become the first).
BATCH, SHOWN, RELATIONS = 40, 200, ("supports", "contradicts", "partially_answers", "background")
#: Evidence rows of one task, on average: so many rows, however little they take when packed, fit its sorts.
ROWS = 500_000


@dataclass(frozen=True)
class Kind:
    """A kind of answer: the fields of its JSON, and a SQL condition on them that a valid one fulfils (fields are answer.<name>)."""

    fields: str
    rule: str


MATCHES = Kind("matches array<struct<index int, relation string, relevance double>>", "forall(coalesce(answer.matches, array()), m -> m.index is not null and coalesce(m.relevance, 0.5) between 0 and 1)")
EXTRACTS = Kind("evidence array<struct<type string, claim string, quote string, confidence double>>", "forall(coalesce(answer.evidence, array()), e -> trim(coalesce(e.claim, '')) != '' and coalesce(e.confidence, 0.5) between 0 and 1)")


def read(answers: DataFrame, kind: Kind) -> DataFrame:
    """answers with answer (null unless valid) and error: missing, malformed or invalid (null if valid), in place of raw."""
    parsed = F.from_json("raw", f"{kind.fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    a = answers.withColumn("answer", parsed)
    error = F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "missing").when(F.col("answer").isNull() | F.col("answer._bad").isNotNull() | ~F.trim("raw").startswith("{"), "malformed").when(~F.expr(f"coalesce({kind.rule}, false)"), "invalid")
    return a.withColumn("error", error).withColumn("answer", F.when(F.col("error").isNull(), F.col("answer").dropFields("_bad"))).drop("raw")


def ask(requests: DataFrame, by: list[str], provider: Callable[[DataFrame], DataFrame], kind: Kind, attempts: int = ATTEMPTS) -> DataFrame:
    """by, attempt, answer, error: the valid answer of each request, or with a null answer the error of its last attempt.

    requests: by (no nulls) and prompt.  An answer to a request that wasn't made is left out; of several to one request the least text counts.
    """
    waiting, done = requests.withColumn("error", F.lit(None).cast("string")), None
    for attempt in range(1, attempts + 1):
        asked = waiting.withColumn("attempt", F.lit(attempt))
        raw = provider(asked).groupBy(*by).agg(F.min("raw").alias("raw"))
        got = cut(read(asked.select(*by, "attempt").join(raw, by, "left"), kind), "answers")
        final = got if attempt == attempts else got.where("error is null")
        done = final if done is None else done.unionByName(final)
        failed = got.where("error is not null").select(*by, "error")
        if attempt == attempts or failed.isEmpty():
            break
        waiting = requests.join(failed, by)
    return done


def _tasks(evidence: DataFrame) -> int:
    return -(-evidence.count() // ROWS) or 1


def match_requests(questions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (question_id, batch, prompt) and the numbered evidence (question_id, batch, index, evidence_id, evidence_type).

    questions: question_id, question, question_type.  evidence: question_id, evidence_id, evidence_type, claim.
    """
    numbered = evidence.repartition(_tasks(evidence), "question_id").selectExpr("question_id", "evidence_id", "evidence_type", "claim", "row_number() over (partition by question_id order by evidence_id, evidence_type, claim) - 1 as n")
    numbered = numbered.selectExpr("question_id", f"cast(floor(n / {BATCH}) as int) as batch", f"cast(n % {BATCH} + 1 as int) as index", "evidence_id", "evidence_type", f"concat(n % {BATCH} + 1, '. [', evidence_type, '] ', left(replace(trim(coalesce(claim, '')), '\\n', ' '), {SHOWN})) as line")
    lists = numbered.groupBy("question_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    prompt = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nType: "), F.coalesce("question_type", F.lit("")), F.lit("\n\nEvidence:\n"), "lines")
    return lists.join(questions, "question_id").select("question_id", "batch", prompt.alias("prompt")), numbered.drop("line")


def match(questions: DataFrame, evidence: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """question_id, evidence_id, relation, relevance, via: judged, retried, or fallback (the rule by evidence types) where two answers to a batch were bad.

    Indices outside the batch are left out; an unknown relation counts as supporting, a missing relevance as 0.5.
    """
    by = ["question_id", "batch"]
    requests, numbered = match_requests(questions, evidence)
    answers = cut(ask(requests, by, provider, MATCHES), "judged")
    found = answers.where("error is null").select(*by, "attempt", F.explode("answer.matches").alias("m")).select(*by, "attempt", "m.*")
    relation = F.when(F.col("relation").isin(*RELATIONS), F.col("relation")).otherwise(RELATIONS[0])
    # Spark would put packed rows together by their bytes, and a task would sort many times these.
    n = _tasks(evidence)
    judged = found.join(numbered.repartition(n, *by, "index"), [*by, "index"]).select("question_id", "evidence_id", relation.alias("relation"), F.coalesce("relevance", F.lit(0.5)).alias("relevance"), F.when(F.col("attempt") == 1, "judged").otherwise("retried").alias("via"))
    left = numbered.repartition(n, *by).join(answers.where("error is not null").select(*by), by).select("question_id", "evidence_id", "evidence_type")
    return judged.unionByName(coverage.heuristic_match(questions, left).withColumn("via", F.lit("fallback")))


def extract(chunks: DataFrame, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunk_id, place, type, claim, confidence, verified (the quote stands in the chunk), via, for chunks (chunk_id, text); a chunk whose answers stay bad gives one row with only via = failed."""
    answers = cut(ask(chunks.select("chunk_id", F.col("text").alias("prompt")), ["chunk_id"], provider, EXTRACTS), "extracted")
    good = answers.where("error is null").select("chunk_id", F.posexplode("answer.evidence").alias("place", "e"), F.when(F.col("attempt") == 1, "judged").otherwise("retried").alias("via"))
    space = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    quoted = (F.coalesce("e.quote", F.lit("")) != "") & F.contains(space(F.col("text")), space(F.col("e.quote")))
    rows = good.join(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "place", "e.type", "e.claim", F.coalesce("e.confidence", F.lit(0.5)).alias("confidence"), F.coalesce(quoted, F.lit(False)).alias("verified"), "via")
    return rows.unionByName(answers.where("error is not null").select("chunk_id", F.lit("failed").alias("via")), allowMissingColumns=True)
