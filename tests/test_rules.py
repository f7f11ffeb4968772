"""Rules of coverage, admission, sections and sources on rows whose results follow from the rules themselves."""

import pytest
from pyspark.sql import functions as F

from evloom import sources
from evloom.operators import coverage, gates, state, text, vectors


def test_sections_and_chunks(spark):
    heads = ["## 3. Methodology", "Experimental setup", "Related Work", "Threats", "4. results", "a framework " + "x" * 80, "Limitations and more", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(heads)], "k int, h string")
    got = {r["k"]: (r["a"], r["b"]) for r in df.select("k", text.classify_heading(F.col("h")).alias("a"), text.strict_heading(F.col("h")).alias("b")).collect()}
    assert [got[k][0] for k in range(8)] == ["method", "experiment", "introduction", None, "experiment", None, "conclusion", None]
    assert [got[k][1] for k in range(8)] == [None, "experiment", None, None, "experiment", None, "conclusion", None]
    t = "one two\n# Method\nthree [TABLE] x [/TABLE] four\n\nfive six seven\nResults\n \n[FIGURE: a b c] eight"
    got = [tuple(r)[1:] for r in text.accumulate_chunks(spark.createDataFrame([(1, t), (2, None), (3, "")], "id int, text string"), "id", 5).orderBy("id", "chunk").collect()]
    assert got == [(0, "unknown", 2, 0), (1, "method", 6, 2), (2, "experiment", 1, 6)]


def test_citations_and_roles(spark):
    clean, share = text.check_citations(F.col("t"), 3)
    got = spark.createDataFrame([("a [P1] b [P9] c [P1] [P03]",), ("none",)], "t string").select(clean.alias("c"), share.alias("s")).collect()
    assert [tuple(r) for r in got] == [("a [P1] b [unsupported] c [P1] [P03]", pytest.approx(2 / 3)), ("none", 0.0)]
    df = spark.createDataFrame([("A Survey", "dataset", 101), ("x", "they cannot", 100), (None, None, None)], "t string, a string, c int")
    assert [r[0] for r in df.select(text.roles(F.col("t"), F.col("a"), F.col("c"))).collect()] == [["survey", "seminal", "benchmark"], ["negative_result"], ["method"]]
    notes = spark.createDataFrame([("x（此处省略）y",), ("(remains unchanged)",), ("（待补充）",), ("a （待补充）",), ("plain (note)",)], "t string")
    assert [r[0] for r in notes.select(text.is_placeholder(F.col("t"))).collect()] == [True, True, True, False, False]


def test_locate_brute(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog and then sleeps all day long"), (2, "xthe quick  brown fox"), (3, "fox"), (4, None), (5, ""), (6, "a\nb c d e f g h i j k l m")]
    items = [(1, "ck brown fox jumps over the la"), (2, "fox"), (3, "quick brown"), (4, "the quick brown fox jumps over the lazy dog and then sle"), (5, "b c d e f g h i j k l"), (6, None), (7, "quick  brown fo"), (8, "b c d")]
    got = {tuple(r) for r in text.locate(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(items, "p int, text string"), "d", "p").collect()}
    assert got == {(p, d, t.index(s)) for p, s in items for d, t in docs if s and t and s in t}


LINK = "question_id int, relevance double, relation_type string, paper_id int, evidence_type string, verification string, locatable boolean"


def test_mining_admission(spark):
    q = spark.createDataFrame([(1, "open"), (2, "superseded"), (3, "covered"), (4, "open"), (5, "open"), (6, "open")], "question_id int, status string")
    rows = [
        (1, 0.6, "supports", 1, "limitation", "abstract_only", False),
        (2, 0.9, "supports", 1, "limitation", "verified", True),
        *[(4, 0.5, "supports", p, "limitation" if p == 1 else "method", "verified", p == 2) for p in (1, 2)],
        *[(5, 0.9, "supports", p, "negative_result", "verified", True) for p in (1, 2)], (5, 0.9, "contradicts", 3, "result", "verified", False),
        *[(6, 0.9, "partially_answers", p, "limitation", "abstract_only", False) for p in (1, 2)], (6, 0.49, "contradicts", 3, "result", "verified", False),
    ]
    got = {r["question_id"]: (r["status"], r["tier"], r["reasons"]) for r in gates.mining_admission(q, spark.createDataFrame(rows, LINK)).collect()}
    assert got == {
        1: ("UNKNOWN", "B", ["INSUFFICIENT_INDEPENDENT_PAPERS", "NO_FULLTEXT_LOCATABLE_EVIDENCE"]),
        2: ("FAIL", "A", ["QUESTION_NOT_ELIGIBLE"]),
        3: ("UNKNOWN", "A", ["NO_LINKED_EVIDENCE"]),
        4: ("PASS", "B", []),
        5: ("UNKNOWN", "A", ["UNRESOLVED_VERIFIED_CONTRADICTION"]),
        6: ("PASS", "B", []),
    }


def test_search_admission(spark):
    make = spark.createDataFrame
    cand = make([(1, False), (2, True), (3, False)], "candidate int, constrained boolean")
    queries = make([(1, 1, "a", "completed"), (1, 2, "a", "failed"), (1, 3, "b", "failed"), (2, 4, "a", "completed")], "candidate int, query_id int, family string, status string")
    results = make([(1, 1, "unknown", 10), (2, 4, "s2", 20)], "candidate int, query_id int, source string, item int")
    corpus, own = make([(2, 21)], "candidate int, item int"), make([(1, 10)], "candidate int, item int")
    got = {r["candidate"]: (r["status"], r["reasons"]) for r in gates.search_admission(cand, queries, results, corpus, own).collect()}
    assert got[2] == ("PASS", []) and got[3] == ("UNKNOWN", ["NO_GAP_QUERIES"])
    assert got[1][1] == ["INSUFFICIENT_COMPLETED_QUERIES", "INSUFFICIENT_QUERY_FAMILIES", "SEARCH_SUCCESS_RATE_TOO_LOW", "NO_SUCCESSFUL_SOURCE", "INSUFFICIENT_GAP_SPECIFIC_PAPERS", "NO_EXTERNAL_NEIGHBOR"]


def test_saturation(spark):
    papers = [(1, p, "high", 1, p / 10) for p in range(6)] + [(1, 50, "medium", 3, 0.05), (1, 60, "low", 2, 0.9), (2, 1, "high", 2, 0.5), (2, 2, "high", 2, 0.4)]
    evidence = [(1, p, 1) for p in range(6)] + [(1, 50, 3), (1, 0, 3), (2, 1, 2), (2, 2, 2)]
    rounds = spark.createDataFrame([(q, r) for q in (1, 2, 3) for r in (1, 2, 3)], "question_id int, round int")
    out = coverage.saturation(rounds, spark.createDataFrame(papers, "question_id int, paper_id int, priority string, round int, score double"), spark.createDataFrame(evidence, "question_id int, paper_id int, round int"))
    got = {(r["question_id"], r["round"]): tuple(r)[2:] for r in out.collect()}
    wait, gain, done = "INSUFFICIENT_OBSERVATION", "STILL_GAINING", "SATURATED"
    assert [got[1, r] for r in (1, 2, 3)] == [(wait, 6, 6, 0.0), (done, 0, 0, 1.0), (done, 1, 2, 1.0)]
    assert [got[2, r][0] for r in (1, 2, 3)] == [wait, gain, gain] and {got[3, r][0] for r in (1, 2, 3)} == {wait}


def test_candidate_reasons(spark):
    make = spark.createDataFrame
    cand = make([(k, "boundary_gap" if k else "idea", k == 5) for k in range(9)], "candidate int, gap_type string, contradicted boolean")
    asked = make([(2, 1), (3, 1), (4, 2), (5, 1), (6, 1), (7, 1), (8, 1), (1, 9)], "candidate int, question_id int")
    offered = make([(10, 1, 100, "limitation"), (11, 1, 101, "method"), (12, 1, 102, "method")], "evidence_id int, question_id int, paper_id int, evidence_type string")
    cited = make([(2, 99), (3, 10), (3, 11), (3, 99), (4, 10), (5, 10), (6, 10), (7, 11), (7, 12)], "candidate int, evidence_id int")
    got = {r["candidate"]: r["reject"] for r in gates.validate_candidates(cand, asked, cited, make([(1,), (2,)], "question_id int"), offered).collect()}
    names = ["UNSUPPORTED_GAP_TYPE", "UNKNOWN_QUESTION_ID", "UNKNOWN_EVIDENCE_ID", None, "EVIDENCE_NOT_LINKED_TO_CITED_QUESTION", "UNEXPECTED_CONTRADICTING_EVIDENCE", "INSUFFICIENT_CANDIDATE_PAPER_SUPPORT", "CANDIDATE_LACKS_LIMITATION_SIGNAL", "UNKNOWN_EVIDENCE_ID"]
    assert [got[k] for k in range(9)] == names


def test_narrowing_and_repeats(spark):
    gaps = [(1, "closed", "x" * 30, 0, "", "", ""), (2, "partially_closed", " short ", 0, "", "", ""), (3, "partially_closed", "x" * 20, 3, "", "", ""), (4, "partially_closed", "x" * 20 + " ", 2, "x" * 20, "", ""), (5, "partially_closed", "x" * 20, 2, "y", "old", "new")]
    out = gates.narrowing(spark.createDataFrame(gaps, "candidate int, result string, remaining string, attempts int, claimed string, existing string, summary string")).collect()
    assert {r["candidate"]: r["skip"] for r in out} == {1: "NO_PARTIALLY_CLOSED_AUDIT", 2: "NO_CONCRETE_REMAINING_DELTA", 3: "NARROW_ATTEMPTS_EXHAUSTED", 4: "DELTA_UNCHANGED", 5: None}
    assert next(r["coverage"] for r in out if r["candidate"] == 5) == "old\n[narrowed after audit] new"
    now = spark.createDataFrame([(k, "c", [2, 1]) for k in range(5)], "candidate int, claim string, neighbours array<int>")
    old = [(0, 1, True, "more_search", "c", [1, 2, 2]), (1, 1, True, "more_search", None, [1, 2]), (2, 1, True, "more_search", "c", [1]), (3, 1, True, "more_search", "c", [1, 2]), (3, 2, True, "narrow", "c", [1, 2]), (4, 1, True, "more_search", "c", [1, 2]), (4, 2, False, "narrow", "c", [1])]
    audits = spark.createDataFrame(old, "candidate int, seq int, decided boolean, action string, claim string, neighbours array<int>")
    assert {r[0]: r[1] for r in gates.repeats(now, audits).collect()} == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_rounds_versions_vectors(spark):
    tries = [(1, 0, 1, False, "a"), (1, 0, 2, True, None), (1, 0, 3, False, "a"), (1, 1, 4, False, "a"), (1, 1, 5, False, "b"), (1, 1, 6, False, "a"), (1, 1, 7, True, None), (2, 0, 1, False, "z"), (2, 0, 2, False, "z"), (2, 0, 3, False, "z"), (2, 1, 4, True, None)]
    got = {r[0]: tuple(r)[1:] for r in state.round_outcomes(spark.createDataFrame(tries, "t int, round int, seq int, ok boolean, error string"), "t").collect()}
    assert got == {1: (1, 1, None), 2: (0, 1, "identical_error")}
    one = lambda t, f: state.contract_version(spark.createDataFrame([(1, t, None, None, "v1")], "k int, task_input string, state_input string, state_feedback string, pipeline_version string"), spark.createDataFrame(f, "k int, seq int, kind string, content string"), "k").first()["version"]
    base = one("topic", [(1, 1, "clarification_answer", "x"), (1, 2, "clarification_answer", "y")])
    assert base == one(" topic ", [(1, 2, "clarification_answer", "y"), (1, 1, "clarification_answer", "x"), (1, 3, "derived", "q")])
    assert base != one("topic", [(1, 2, "clarification_answer", "x"), (1, 1, "clarification_answer", "y")])
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "text string")
    assert [sum(r["vec"]) for r in vectors.embed(df, 8, vectors.hashed_bag(8)).collect()] == [3.0, 0.0, 0.0]
    with pytest.raises(Exception, match="must have 9 numbers"):
        vectors.embed(df, 9, vectors.hashed_bag(8)).collect()


def test_search_skips_sources_without_key(spark):
    hits = spark.createDataFrame([(1, r, f"t{r}") for r in range(4)] + [(2, 0, "u")], "query_id int, rank int, title string")
    found = sources.search(spark.createDataFrame([(1,), (1,)], "query_id int"), sources.available({"arxiv": hits, "ieee": hits, "core": hits}, {"core": "k"}), 2)
    assert sorted((r["source"], r["title"]) for r in found.collect()) == [("arxiv", "t0"), ("arxiv", "t1"), ("core", "t0"), ("core", "t1")]
