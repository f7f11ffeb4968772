"""Scores with penalties, queries that may be sent, and the blocks a judge and a reader see."""

import pytest

from evloom.operators import briefs, ideas


def test_scores(spark):
    dims = "novelty double, feasibility double, significance double, evidence double, differentiation double, experiment double, impact double, risk double"
    one = (1.0,) * 7 + (0.0,)
    rows = [("top", *one, True, 0, None, 0), ("known", *one, False, 0, 0, 0), ("unsearched", *one, None, 0, 0, 0), ("capped", *one, True, 9, 9, 9), ("some", *one, True, 1, 1, 1), ("zero", *(0.0,) * 7, 1.0, True, 0, 0, 0), ("floor", *(0.0,) * 7, 1.0, True, 1, 0, 0), ("low_novelty", 0.05, *one[1:], False, 0, 0, 0)]
    got = {r.id: (r.score, r.penalty, r.decision, r.novelty) for r in ideas.score_ideas(spark.createDataFrame(rows, f"id string, {dims}, novel boolean, metrics int, fabricated int, enriched int")).collect()}
    want = {"top": (1, 0, "go"), "known": (0.98, 0, "go"), "unsearched": (0.99, 0, "go"), "capped": (0.45, 0.55, "reject"), "some": (0.77, 0.23, "go"), "zero": (-0.08, 0, "reject"), "floor": (0, 0.05, "reject"), "low_novelty": (0.8, 0, "go")}
    assert {k: v[:3] for k, v in got.items()} == {k: (pytest.approx(s), pytest.approx(p), d) for k, (s, p, d) in want.items()} and got["low_novelty"][3] == 0.05


def test_valid_queries(spark):
    rows = [
        (1, 1, 1, "A  b", "q"), (1, 1, 2, "a B", "q"), (1, 1, 3, "c", "other"), (1, 1, 4, "d", "q"), (1, 2, 1, "a b", "q"), (1, 2, 2, "e", "q"),
        (2, 1, 1, "a", "q"), (2, 1, 2, "b", "q"), (2, 1, 3, "c", "q"), (2, 1, 4, "d", "q"), (2, 1, 5, "e", "q"), (2, 2, 1, "f", "q"), (3, 1, 1, "a", "other"), (4, 1, 1, "a", "q"), (4, 2, 1, "b", "q"),
    ]
    generated = spark.createDataFrame(rows, "task int, attempt int, place int, text string, question_id string")
    questions = spark.createDataFrame([(k, "q") for k in range(1, 5)], "task int, question_id string")
    got = {r.task: (r.status, [x.text for x in r.queries or []]) for r in ideas.valid_queries(generated, questions, 4).collect()}
    assert got == {1: ("sent", ["A  b", "d", "e"]), 2: ("sent", ["a", "b", "c", "d"]), 3: ("failed", []), 4: ("failed", [])}
    assert {r.task: r.status for r in ideas.valid_queries(generated, questions, 1).collect()} == {1: "sent", 2: "sent", 3: "failed", 4: "sent"}


def test_references_and_block(spark):
    papers = spark.createDataFrame([("t", 2, "B", 2020, None), ("t", 1, "A", None, "10.1/x"), ("u", 1, "C", 1, "")], "task string, place int, title string, year int, doi string")
    assert {r.task: r["list"] for r in briefs.references(papers).collect()} == {"t": "## 参考文献\n\n[P1] A (None). DOI: 10.1/x\n[P2] B (2020). DOI: N/A", "u": "## 参考文献\n\n[P1] C (1). DOI: N/A"}
    evidence = spark.createDataFrame([("t", 2, "e2", "p", "result", "says", None, "{}", None), ("t", 1, "e1", "p", "limit", "fails", "intro", '{"a": 1}', "verified")], "task string, place int, evidence_id string, paper_id string, type string, claim string, section string, conditions string, status string")
    block = briefs.evidence_block(evidence, spark.createDataFrame([("e2", "q2"), ("e2", "q1"), ("e2", "q1"), ("e1", None)], "evidence_id string, question_id string")).first().block
    assert block == (
        '- Evidence ID: e1\n  Paper ID: p\n  Type: limit\n  Claim: fails\n  Section: intro\n  Conditions: {"a": 1}\n  Verification: verified\n'
        "- Evidence ID: e2\n  Paper ID: p\n  Type: result\n  Claim: says\n  Section: (unknown)\n  Conditions: (none)\n  Verification: unverified\n  Linked questions: q1, q2"
    )


def test_hard_gates(spark):
    from evloom.operators import interventions as gates

    flags = {"free": (True, True, True), "unsaid": (None, None, None), "no_training": (False, True, True), "bare": (False, True, False), "no_large": (True, False, True), "no_gpu": (True, True, False)}
    cases = [
        ("free", "we train a model on a large benchmark", None, "PASS"), ("unsaid", "training", None, "PASS"), ("no_training", "Fine-Tune it", None, "WARN"), ("bare", "we train it", None, "FAIL"), ("bare", "ask", "then training", "WARN"), ("bare", "train", None, "WARN"),
        ("no_large", "a benchmark", "large-scale", "FAIL"), ("no_large", "a large benchmark, micro-benchmark first", None, "PASS"), ("no_large", "a Benchmark", None, "WARN"), ("no_large", "large-scale", None, "PASS"), ("no_gpu", "on a GPU", None, "WARN"), ("no_gpu", "ask", "gpu", "PASS"), ("no_gpu", None, None, "PASS"), ("gone", "训练", None, "PASS"),
    ]
    rows = spark.createDataFrame([(k, k, core, cost) for k, (_, core, cost, _) in enumerate(cases)] + [(100 + k, 100 + k, "ask", None) for k in range(5)], "intervention_id int, gap_id int, core string, cost string")
    audits = {100: [("confirmed", "x", 1)], 101: [("confirmed", "x", 1), ("closed", None, 2)], 102: [("partially_closed", "x", 1)], 103: [("confirmed", None, 1)], 104: [("closed", None, 1), ("confirmed", "x", 2)]}
    gaps = spark.createDataFrame([(k, c[0], True) for k, c in enumerate(cases)] + [(k, "free", k != 104) for k in audits], "gap_id int, contract_id string, complete boolean")
    evidence = spark.createDataFrame([(g, e) for g in audits for e in ((1, 1) if g == 102 else (1, 2))], "gap_id int, evidence_id int")
    seen = spark.createDataFrame([(g, at, r, left) for g, x in audits.items() for r, left, at in x], "gap_id int, created int, result string, remaining string")
    contracts = spark.createDataFrame([(k, *v) for k, v in flags.items()], "contract_id string, allow_training boolean, allow_large_benchmark boolean, gpu_available boolean")
    got = {r.intervention_id: r for r in gates.hard_gates(rows, gaps, evidence, seen, contracts).collect()}
    assert [got[k].feasible for k in range(len(cases))] == [c[-1] for c in cases] and {got[k].evidence for k in range(len(cases))} == {"FAIL"}
    assert {k: (got[k].evidence, got[k].novelty, got[k].tier) for k in audits} == {100: ("PASS", "PASS", "A"), 101: ("PASS", "FAIL", "C"), 102: ("FAIL", "UNKNOWN", "C"), 103: ("PASS", "UNKNOWN", "B"), 104: ("PASS", "PASS", "B")}


def test_search_budget(spark):
    from evloom.operators import budgets

    gap, other = budgets.OF_FAMILIES, "readiness_more_research"
    ledger = [(1, gap, "f", 1), (1, gap, "f", 2), (2, gap, "f", 1), (2, gap, "g", 1), (3, other, None, 1), (3, other, None, 2), (4, other, None, 1), (4, gap, "f", 2), (4, gap, "f", 3)]
    requests = [(1, gap, "f"), (1, gap + ": again", "f"), (1, gap + ": again", "new"), (1, other, None), (2, gap, "f"), (3, other + " x", None), (3, gap, None), (4, gap, "new"), (5, "why", "f"), (5, "", "f"), (5, None, "f"), (6, gap, "f")]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = make(requests, "task int, reason string, family string"), make(ledger, "task int, key string, family string, round int")
    got = {(r.task, r.reason): (r.refused, r.families_left) for r in budgets.may_search(*args).collect()}
    assert got == {
        (1, gap): ("family budget", 0), (1, gap + ": again"): (None, 1), (1, other): (None, 0), (2, gap): (None, 1), (3, other + " x"): ("reason budget", 0), (3, gap): ("no family", 0), (4, gap): ("task budget", 1),
        (5, "why"): ("unknown reason", 1), (5, ""): ("unknown reason", 1), (5, None): ("unknown reason", 1), (6, gap): (None, 1),
    }
    assert {r.refused for r in budgets.may_search(*args, a_reason=0).collect()} == {"disabled"}
