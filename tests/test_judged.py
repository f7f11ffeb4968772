"""Judgements that are retried and replaced, stage versions, briefs and index pages."""

from pyspark.sql import functions as F

from evloom.operators import briefs, judgements, versions

FINE = '{"matches": [{"index": 1, "relation": "contradicts", "relevance": 1}, {"index": 2, "relation": "strange"}, {"index": 3}, {"index": 0}]}'


def test_read_errors(spark):
    raws = [FINE, '{"matches": [', '{"matches": [{"index": "x"}]}', '{"matches": [{"relation": "supports"}]}', '{"matches": [{"index": 1, "relevance": 1.01}]}', "[]", "text", "", None, "{}", '{"matches": []}', '{"other": 1}']
    got = {r.id: (r.error, r.answer is not None) for r in judgements.read(spark.createDataFrame(list(enumerate(raws)), "id int, raw string"), judgements.MATCHES).collect()}
    assert [got[k][0] for k in range(12)] == [None, "malformed", "malformed", "invalid", "invalid", "malformed", "malformed", "missing", "missing", None, None, None]
    assert all((e is None) == has for e, has in got.values())


def test_match_retries_then_falls_back(spark):
    q = spark.createDataFrame([(k, f"what {k}?", "method") for k in range(1, 5)], "question_id int, question string, question_type string")
    kinds = ["method", "result", "limitation"]
    e = spark.createDataFrame([(k, 100 * k + n, kinds[n % 3], "a\nclaim" * 60) for k in range(1, 5) for n in range(42 if k == 1 else 2)], "question_id int, evidence_id int, evidence_type string, claim string")
    asked = []

    def provider(requests):
        rows = requests.collect()
        asked.append({(r.question_id, r.batch): (r.prompt, r.error) for r in rows})
        answer = {1: [FINE, None], 2: ["no", FINE], 3: ["no", '{"matches": [{"index": 1, "relevance": -1}]}'], 4: [None, None]}
        return spark.createDataFrame([(r.question_id, r.batch, answer[r.question_id][r.attempt - 1]) for r in rows] + [(99, 0, FINE)], "question_id int, batch int, raw string")

    got = {(r.question_id, r.evidence_id): (r.relation, r.relevance, r.via) for r in judgements.match(q, e, provider).collect()}
    assert set(asked[0]) == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)} and {k: x[1] for k, x in asked[1].items()} == {(2, 0): "malformed", (3, 0): "malformed", (4, 0): "missing"}
    first = asked[0][1, 0][0]
    assert first.startswith("Question: what 1?\nType: method\n\nEvidence:\n1. [method] a claim") and first.count("\n") == 4 + 39 and len(first.split("\n")[4]) == len("1. [method] ") + 200
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 100): ("contradicts", 1, "judged"), (1, 101): ("supports", 0.5, "judged"), (1, 102): ("supports", 0.5, "judged"), (1, 140): ("contradicts", 1, "judged"), (1, 141): ("supports", 0.5, "judged")}
    assert got[2, 200] == ("contradicts", 1, "retried") and got[2, 201][2] == "retried"
    assert {v[2] for k, v in got.items() if k[0] in (3, 4)} == {"fallback"} and got[3, 300] == ("supports", 0.5, "fallback")


def test_extract(spark):
    chunks = spark.createDataFrame([(1, "The  Method fails\non long texts."), (2, "x")], "chunk_id int, text string")
    raw = '{"evidence": [{"type": "limitation", "claim": "fails", "quote": "method FAILS on", "confidence": 0.9}, {"type": "result", "claim": "works", "quote": "works"}]}'
    rows = {(r.chunk_id, r.place): r for r in judgements.extract(chunks, lambda a: a.select("chunk_id", F.when(F.col("chunk_id") == 1, raw).alias("raw"))).collect()}
    assert (rows[1, 0].verified, rows[1, 0].confidence, rows[1, 1].verified, rows[1, 1].confidence) == (True, 0.9, False, 0.5) and rows[2, None].via == "failed" and len(rows) == 3


def test_one_changed_input_changes_what_follows(spark):
    kinds = {c: "array<string>" for c in versions.SETS} | {"round_number": "int", "clarification_questions": "array<string>"}
    columns = sorted({c for fields, _ in versions.STAGES.values() for c in fields})
    value = lambda c: ["a", "b"] if "array" in kinds.get(c, "") else 1 if c == "round_number" else "x"
    schema = "run string, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)
    changed = {"round_paper_ids": ["a", "z"], "user_input": "y", "surviving_gap_ids": None, "scored_count": "9", "intervention_ids": []}
    rows = [("same", *map(value, columns)), ("order", *(value(c)[::-1] if c in versions.SETS else value(c) for c in columns))] + [(k, *(v if c == k else value(c) for c in columns)) for k, v in changed.items()]
    base = versions.stage_versions(spark.createDataFrame([(r[0], *map(value, columns)) for r in rows], schema), "run")
    got = {}
    for r in versions.invalidated(base, versions.stage_versions(spark.createDataFrame(rows, schema), "run"), "run").collect():
        got.setdefault(r.run, {})[r.stage] = r.why
    later = dict.fromkeys(("coverage", "mining", "audit", "phenomenon", "intervention", "experiment"), "inherited")
    assert got == {
        "round_paper_ids": {"evidence": "changed"} | later, "user_input": {"clarify": "changed"} | dict.fromkeys(("search", "evidence", "summarize"), "inherited") | later,
        "surviving_gap_ids": {"phenomenon": "changed", "intervention": "changed", "experiment": "inherited"}, "scored_count": {"summarize": "changed"}, "intervention_ids": {"experiment": "changed"},
    }
    assert versions.invalidated(base.where("false"), base.where("run = 'same'"), "run").where("why = 'new'").count() == len(versions.STAGES)


def test_brief_of_an_empty_task_and_index(spark):
    make = spark.createDataFrame
    tasks = make([(1, None, None), (2, "T", "over")], "task int, topic string, explanation string")
    none = lambda schema: make([], schema)
    gaps = make([(2, 5, 1, 1, 1, "superseded", True, "old", None, None, None, None, None), (2, 6, 1, 2, 2, "surviving", True, "new\none", "P", None, "low", 0.625, 0.6)], "task int, gap_id int, canonical int, version int, created int, status string, complete boolean, description string, nearest string, residual string, confidence string, stability double, families double")
    plans = make([(6, "ph", None, None, "ex", "kill", None)], "gap_id int, " + ", ".join(f"{c} string" for c, *_ in briefs.PLAN))
    papers = make([(2, 1, None), (2, 2, "high")], "task int, paper_id int, priority string")
    got = {r.task: r.brief for r in briefs.brief(tasks, none("task int, question_id int, question string, importance double, status string"), none("question_id int, round int, score double, unavailable string, quality double, saturation string"), papers, make([(2, "survey")], "task int, role string"), none("task int, evidence_id int, paper_id int, type string, claim string, status string"), gaps, plans, none("task int, place int, step string")).collect()}
    h = briefs.HEADINGS
    assert got[1].split("\n\n")[1] == "> 研究方向：(未指定)" and h[0].strip() not in got[1] and briefs.NO_QUESTIONS.strip() in got[1] and "入库论文 0 篇" in got[1] and briefs.NO_GAPS.strip() in got[1]
    assert got[2].index(h[0]) < got[2].index(h[1]) < got[2].index(h[2]) < got[2].index(h[3]) < got[2].index(h[4]) < got[2].index(h[5])
    assert "- [存活][A(全文支撑)] v2 new one\n  - 最近已知 prior art: P\n  - 检索置信度: 低，近邻稳定性 0.62，query family 覆盖 60%\n  - 待验证现象: ph\n  - 证伪实验: ex\n  - 放弃判据: kill\n" in got[2] and "old" not in got[2] and "另有 1 篇" in got[2]
    pages = make([(1, "model", "b", ["x"]), (1, "concept", "z", None), (1, "concept", "a", ["x", "y"]), (1, "odd", "q", None), (2, "index", "i", None)], "task int, type string, title string, papers array<string>")
    assert {r.task: r["index"] for r in briefs.index_page(pages).collect()} == {1: "# Wiki Index\n\n\n## 研究概念 (Concepts)\n\n- **a** (2 papers)\n- **z** (0 papers)\n\n## 模型 (Models)\n\n- **b** (1 papers)"}
