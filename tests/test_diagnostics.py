"""Search diagnostics with the numbers of two variants that share a paper, and the four confidence states."""

import itertools
import random
from statistics import median

import pytest

from evloom.operators import diagnostics


def _tables(spark, queries, raw, kept, scores):
    return (
        spark.createDataFrame(queries, "candidate string, family string, query_id string"), spark.createDataFrame(raw, "query_id string, raw_rank int, row_id int, external_id string, title string, canonical_id string"),
        spark.createDataFrame(kept, "query_id string, rank int, paper_id string"), spark.createDataFrame(scores, "candidate string, paper_id string, final_score double, priority string"),
    )


def test_two_variants(spark):
    queries = [("g", "exact", "q1"), ("g", "exact", "q2"), ("g", "single", "q3"), (None, "exact", "q4")]
    raw = [("q1", 0, 1, "A1", "Shared Paper", None), ("q1", 1, 2, "B", "Beta", None), ("q2", 0, 3, "A2", "Shared Paper", None), ("q2", 1, 4, "C", "Gamma", None)]
    kept = [("q1", 0, "pShared"), ("q1", 1, "pBeta"), ("q2", 0, "pShared"), ("q2", 1, "pGamma"), ("q3", 0, "pBeta")]
    q, *rest = _tables(spark, queries, raw, kept, [("g", "pShared", 0.9, "high"), ("g", "pBeta", None, "low")])
    got = {(r.family, r.stage, r.k): (r.queries, r.jaccard, r.overlap) for r in diagnostics.waterfall(q, diagnostics.search_index(q, *rest)).collect()}
    assert len(got) == 2 * 5 * 3
    assert got["exact", "raw", 5] == (2, 0, 0) and got["exact", "canonical", 5] == got["exact", "post_filter", 5] == got["exact", "final", 20] == (2, pytest.approx(1 / 3), 0.5)
    assert got["exact", "high_value", 10] == (2, 1, 1) and got["single", "post_filter", 5] == (1, None, None)


def test_medians_against_all_pairs(spark):
    rng = random.Random(2)
    queries = [("g", "f", f"q{k}") for k in range(9)]
    kept = [(q, r, f"p{rng.randrange(40)}") for _, _, q in queries[:8] for r in range(rng.randrange(1, 25))]
    q, *rest = _tables(spark, queries, [("q0", 0, 1, None, None, None)], kept, [("g", "p1", 0.5, "high")])
    got = {r.k: r for r in diagnostics.waterfall(q, diagnostics.search_index(q, *rest)).where("stage = 'post_filter'").collect()}
    for k in (5, 10, 20):
        sets = [s for _, _, x in queries if (s := {p for y, r, p in kept if y == x and r < k})]
        pairs = list(itertools.combinations(sets, 2))
        assert got[k].jaccard == pytest.approx(median(len(a & b) / len(a | b) for a, b in pairs)) and got[k].overlap == pytest.approx(median(len(a & b) / min(len(a), len(b)) for a, b in pairs))


def test_confidence(spark):
    rows, place, audits, curve = [], [], [], []
    cases = {"none": (5, 5, None, None), "high": (5, 4, 5, 0.6), "drifting": (5, 3, 5, 0.5), "few": (3, 5, 5, None), "narrow": (2, 5, 5, 1.0), "apart": (5, 1, 5, 1.0)}
    for name, (families, shared, before, convergence) in cases.items():
        rows += [(name, f"f{f}", "post_filter", k, 2, 0.2 if f == 0 else 0.5, 1.0) for f in range(families) for k in (5, 10, 20)]
        place += [(name, k, f"{name}{k}") for k in range(7)]
        audits += [(name, 1, "PASS", ["old"])] * (before is None) + ([(name, 1, "PASS", [f"{name}{k}" for k in range(5 - shared, 12 - shared)]), (name, 2, "PASS", []), (name, 3, "BLOCKED", [])] if before else [])
        curve += [(name, 1, None), (name, 2, convergence)]
    falls = spark.createDataFrame(rows, "candidate string, family string, stage string, k int, queries long, jaccard double, overlap double")
    cross = diagnostics.rounds(spark.createDataFrame(place, "candidate string, place int, paper_id string"), spark.createDataFrame(audits, "candidate string, created int, admission string, neighbours array<string>"))
    got = {r.candidate: r for r in diagnostics.diagnostics(falls, cross, spark.createDataFrame(curve, "candidate string, prefix int, stability double")).collect()}
    assert {k: r.confidence for k, r in got.items()} == {"none": "INSUFFICIENT_OBSERVATION", "high": "high", "drifting": "medium", "few": "medium", "narrow": "low", "apart": "low"}
    assert got["high"].cross_round == 0.8 and got["few"].family_coverage == 0.6 and got["high"].unstable == "f0" and got["high"].at_10 == 0.5 and got["narrow"].at_5 == pytest.approx(0.35)


def test_index_is_shuffled_once(spark):
    """Waterfalls used to shuffle the index eight times or more, with a row for each stage, item and depth."""
    q, *rest = _tables(spark, [("g", "f", "q1"), ("g", "f", "q2")], [("q1", 0, 1, "A", None, None), ("q2", 0, 2, "A", None, None)], [("q1", 0, "p"), ("q2", 0, "p")], [("g", "p", 0.5, "high")])
    index = diagnostics.search_index(q, *rest)
    assert "entries" in index.columns
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(diagnostics.waterfall(q, index)) - shuffles(index) <= 4


def test_stages_against_plain_lists(spark):
    rng = random.Random(5)
    queries = [(f"g{c}", f"f{c % 2}", f"q{c}-{k}") for c in range(3) for k in range(6)]
    raw = [(q, r, 100 * n + r, rng.choice([None, "A", "B", "C"]), rng.choice([None, "", "T1", "T2", "T3", "T4"]), rng.choice([None, "x"])) for n, (_, _, q) in enumerate(queries) for r in range(rng.randrange(0, 26))]
    kept = [(q, r, f"p{rng.randrange(12)}") for _, _, q in queries for r in range(rng.randrange(0, 26))]
    scores = [(c, f"p{p}", rng.choice([None, 0.1, 0.5]), rng.choice(["high", "low", None])) for c in ("g0", "g1", "g2") for p in range(10)]
    q, *rest = _tables(spark, queries, raw, kept, scores)
    got = {(r.candidate, r.stage, r.k): (r.jaccard, r.overlap) for r in diagnostics.waterfall(q, diagnostics.search_index(q, *rest)).collect()}
    score = {(c, p): (s or 0.0, h) for c, p, s, h in scores}
    title = lambda t: "hash:" + t if t and t.strip() else None
    lists = {}
    for c, _, name in queries:
        hits = [x for x in raw if x[0] == name]
        mine = sorted((r, p) for x, r, p in kept if x == name)
        keys = [title(t) or (i and "paper:" + i) or (e and "ext:" + e) or f"row:{n}" for _, _, n, e, t, i in hits]
        lists[c, name] = {
            "raw": [(e and "ext:" + e) or title(t) or f"row:{n}" for _, _, n, e, t, _ in hits], "canonical": list(dict.fromkeys(keys)), "post_filter": [p for _, p in mine],
            "final": [p for _, _, p in sorted((-score.get((c, p), (0.0, None))[0], r, p) for r, p in mine)], "high_value": [p for _, p in mine if score.get((c, p), (0, None))[1] == "high"],
        }
    for (c, stage, k), value in got.items():
        sets = [s for (x, _), by in lists.items() if x == c and (s := set(by[stage][:k]))]
        pairs = list(itertools.combinations(sets, 2))
        want = (median(len(a & b) / len(a | b) for a, b in pairs), median(len(a & b) / min(len(a), len(b)) for a, b in pairs)) if pairs else (None, None)
        assert value == pytest.approx(want), (c, stage, k)


def test_families_are_gone_through_in_order(spark):
    """Entries, lists, items and pairs were grouped and sorted one after another before. Families cut by the ends of batches, of other types, null items, and one of a single variant."""
    rng = random.Random(9)
    rows, want = [], {}
    for c in range(6):
        for f in (10, 20):
            lists = {}
            for q in range(1 if f == 20 and c == 0 else 1 + rng.randrange(1, 9)):
                items = [None if i == 7 else f"i{i}" for i in rng.sample(range(30), rng.randrange(0, 22))]
                lists[q] = items
                rows += [(c, f, 1000 * c + 10 * f + q, [(2, x, r)]) for r, x in enumerate(items) if r < 20]
            for k in (5, 10, 20):
                sets = [(len(x[:k]), {i for i in x[:k] if i}) for x in lists.values() if x]
                pairs = [(len(a & b), n, m) for (n, a), (m, b) in itertools.combinations(sets, 2)]
                want[c, f, k] = (median(b / (n + m - b) for b, n, m in pairs), median(b / min(n, m) for b, n, m in pairs)) if pairs else (None, None)
    rng.shuffle(rows)
    index = spark.createDataFrame(rows, "candidate int, family long, query_id int, entries array<struct<stage: int, item: string, rank: int>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = diagnostics.waterfall(spark.createDataFrame([(c, f, 0) for c in range(6) for f in (10, 20)], "candidate int, family long, query_id int"), index)
        got = {(r.candidate, r.family, r.k): (r.jaccard, r.overlap) for r in out.where("stage = 'post_filter'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    for at, (jaccard, overlap) in want.items():
        assert got[at] == ((None, None) if jaccard is None else (pytest.approx(jaccard), pytest.approx(overlap)))
    assert out._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate") == 0


def test_one_stage_is_taken_from_the_index(spark):
    """DEC23 took all five stages through the waterfall for one of them before."""
    index = spark.createDataFrame([("g", "f", 1, [(0, "a", 0), (2, "p", 0)]), ("g", "f", 2, [(2, "p", 0)]), ("g", "f", 3, [(0, "a", 0)])], "candidate string, family string, query_id int, entries array<struct<stage: int, item: string, rank: int>>")
    assert {(r.query_id, *map(tuple, r.entries)) for r in diagnostics.at_stage(index, "post_filter").collect()} == {(1, (2, "p", 0)), (2, (2, "p", 0))}
