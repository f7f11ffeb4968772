"""Names in texts, pages of reads, and the readiness gate, against plain Python."""

import random
import re

import pytest

from evloom import reads
from evloom.operators import gates, names


def test_known_names_brute(spark):
    rng = random.Random(3)
    wanted = ["GAT", "gat", "BERT-4", "A", "Cat", "LongName", "Deep Net", "é-net", "x.y", "--", None, "", "naïve", "中文模型"]
    parts = ["concatenate", "GAT", "gat-x", "(cat)", "mylongnames", "deep net", "deepnet", "BERT-4", "bert-42", "a", "b", "é-net", "x.y", "xzy", "NAÏVE", "新中文模型了", "--"]
    docs = [(i, " ".join(rng.choices(parts, k=rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "gat " * 5000)]
    got = {tuple(r) for r in names.known_names(spark.createDataFrame(docs, "id int, body string"), spark.createDataFrame([(w,) for w in wanted], "n string"), "id", "body", "n").collect()}
    find = lambda n, t: re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", t) if len(n) <= 4 else n in t
    assert got == {(i, w) for i, t in docs if t for w in wanted if w and re.search(r"\w", w) and find(w.lower(), t.lower())}


def test_name_lists(spark):
    text = "We use BigBench and Defects4J with GPT-4 on MyData. The Repair of X1y by Self-Debug; Ab Zz9"
    titles = [("t", "The Deep Learning SuperTool Again More"), ("t", None), ("u", "Nine Ten Eleven Twelve")]
    got = {}
    for r in names.name_lists(spark.createDataFrame([("t", text), ("v", None), ("w", " ".join(f"N{k:03}" for k in range(150)))], "task string, text string"), spark.createDataFrame(titles, "task string, title string")).collect():
        got.setdefault(r.task, []).append((r.place, r.name))
    assert [n for _, n in sorted(got["t"])] == ["BigBench", "Defects4J", "GPT-4", "MyData", "Self-Debug", "X1y", "Zz9"] and [n for _, n in sorted(got["u"])] == ["Eleven", "Nine", "Ten"]
    assert sorted(got["w"]) == [(k + 1, f"N{k:03}") for k in range(100)] and "v" not in got


def test_pages_hold_every_row_once(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, "a", "b"])) for i in range(57)]
    df = spark.createDataFrame(rows, "id int, score double, kind string")
    order = [("score", True), ("kind", False), ("id", False)]
    seen, after = [], None
    while page := reads.keyset(df, order, after, 20).collect():
        seen += [tuple(r) for r in page]
        after = (page[-1]["score"], page[-1]["kind"], page[-1]["id"])
    assert seen == sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0]))
    for bad in (0, 201):
        with pytest.raises(ValueError):
            reads.keyset(df, order, None, bad)


def test_reads_of_a_task(spark):
    make = spark.createDataFrame
    tables = {
        "contracts": make([("c1", 1, 1), ("c2", 1, 2), ("c9", 2, 9)], "contract_id string, task_id int, version int"),
        "questions": make([("q1", "c1", 1, 0.9), ("q2", "c2", 1, None), ("q3", "c2", 1, 0.4)], "question_id string, contract_id string, task_id int, importance double"),
        "gaps": make([("g1", 1, "k", 1, 1, "superseded"), ("g2", 1, "k", 2, 2, "surviving"), ("g3", 1, "m", 1, 3, "rejected"), ("g4", 2, "z", 1, 4, "surviving")], "gap_id string, task_id int, canonical_gap_id string, version int, created_at int, status string"),
        "gap_audits": make([("a1", "g2", 1), ("a2", "g2", 5), ("a3", "g4", 9)], "audit_id string, gap_id string, created_at int"),
        "experiments": make([("e2", 1, 2), ("e1", 1, 1)], "experiment_id string, task_id int, created_at int"),
        "coverage": make([("v1", 1, "q2", 1), ("v2", 1, "q2", 3)], "coverage_id string, task_id int, question_id string, round_number int"),
    }
    r = reads.Reads(tables.__getitem__, 1)
    ids = lambda df: [x[0] for x in df.collect()]
    assert ids(r.contract().select("contract_id")) == ["c2"] and ids(r.questions().select("question_id")) == ["q3", "q2"]
    assert ids(r.gaps().select("gap_id")) == ["g2", "g3"] and ids(r.gaps("rejected").select("gap_id")) == ["g3"] and ids(r.gaps(after=(2, "g2")).select("gap_id")) == ["g3"]
    assert ids(r.gap_audits("g2").select("audit_id")) == ["a2", "a1"] and ids(r.gap_audits("g4").select("audit_id")) == []
    assert ids(r.export().select("json")) == [f'{{"created_at":{k},"experiment_id":"e{k}","task_id":1}}' for k in (1, 2)] and ids(r.coverage().select("coverage_id")) == ["v2"]


def test_readiness_looks_at_important_questions(spark):
    cases = {  # importance, snapshot, score, unavailable, evidence
        "no_one_important": ([(0.2, False, None, False, 1)], True, ("ready", "")), "low_missing": ([(0.9, True, 0.1, False, 0), (0.1, False, None, False, 1), (0.2, False, None, False, 0)], True, ("ready", "")),
        "half": ([(0.9, True, 1.0, False, 1), (0.9, False, None, False, 0)], True, ("more", "snapshots")), "none": ([(0.7, False, None, False, 1)], True, ("failed", "no snapshot of an important question")),
        "zero": ([(0.9, True, 0.0, False, 1), (0.1, True, 1.0, False, 1)], True, ("more", "coverage")), "known_gap": ([(0.9, True, 0.0, True, 1)], True, ("ready", "")),
        "bare": ([(None, True, 1.0, False, 0)], True, ("failed", "no evidence")), "empty": ([], True, ("failed", "no questions")), "closed": ([(0.9, True, 1.0, False, 1)], False, ("failed", "contract not active")),
    }
    tasks = spark.createDataFrame([(k, True, active) for k, (_, active, _) in cases.items()], "task string, has_contract boolean, active boolean")
    rows = spark.createDataFrame([(k, *r) for k, (x, *_) in cases.items() for r in x], "task string, importance double, has_snapshot boolean, score double, unavailable boolean, evidence int")
    assert {r.task: (r.status, r.reason) for r in gates.readiness(tasks, rows).collect()} == {k: want for k, (*_, want) in cases.items()}


def test_known_names_of_every_kind(spark):
    """Short ones stand alone, long ones inside runs, those of several parts across them."""
    wanted = ["In", "IN", "Net", "a-b", "Rain on", "Long-Name", "Rains", "-x-", "Été", "Ünder", "c4", "B on", "--"]
    bodies = ["in net", "inn, (In) net9", "éin ünders", "trains rain on", "terrain on long-names", "a-b", "xa-b a-bc", "q-x-r", "été c4 c45", "rain\non b on", None, ""]
    got = {tuple(r) for r in names.known_names(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), spark.createDataFrame([(w,) for w in [*wanted, "In", None]], "n string"), "id", "body", "n").collect()}
    import re

    stands = lambda t, n: re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", t) if len(n) <= 4 else n in t
    assert got == {(i, w) for i, t in enumerate(bodies) if t for w in wanted if w != "--" and stands(t.lower(), w.lower())}


def test_texts_are_dealt_once(spark, monkeypatch):
    """Each run of each text was a row of a shuffle, and names were gathered by text in another one. Small blocks here, long runs, runs that only their middle fits, other scripts and marks."""
    for name, n in (("BLOCK", 200), ("HELD", 5)):
        monkeypatch.setattr(names, name, n, raising=False)
    rng = random.Random(8)
    wanted = ["Abcdefgh", "Bcdef", "Efg", "Abc", "Cde-f", "Bcd on", "Ü", "Éa", "C-d", "On", "Gh", "中文", "Def gh-a", "²x", "İzmir"]
    parts = ["abcdefgh", "xabcdefghx" * 3, "abc", "cde-f", "abcd on", "bcd onto", "ü", "éa", "éabc", "c-d", "c-de", "gh", "abc_efg", "on", "中文字", "def gh-a", "²x", "İZMİR", "ABC", "éefg"]
    bodies = [rng.choice([" ", "_", ", "]).join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(80)] + [None, "", "abc"]
    out = names.known_names(spark.createDataFrame(list(enumerate(bodies)), "id int, body string"), spark.createDataFrame([(w,) for w in wanted], "n string"), "id", "body", "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    stands = lambda t, n: re.search(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])", t) if len(n) <= 4 else n in t
    want = {(i, w) for i, t in enumerate(bodies) if t for w in wanted if stands(t.lower(), w.lower())}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "hashpartitioning(_k" not in plan
