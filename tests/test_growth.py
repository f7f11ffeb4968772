"""What queries shuffle, and that lean forms give the same rows on odd input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evloom.operators import briefs, graph, similar, vectors
from evloom.plans import q_domain, q_identity, q_ranking, q_reports
from tests.test_texts import distance


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(1, "b A a  B a c", "x"), (1, "C d", "y"), (2, None, "x"), (3, "", "x"), (4, "one two one", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_words_stay_in_their_text(spark, docs):
    """A shuffle of a row for each word was made before."""
    out = q_identity.DED11_12_ordered_distinct(spark, docs)
    got = {r.doc_id: r.kept for r in out.collect()}
    assert set(got) == {1, 3, 4} and got[3] == "" and got[4] == "one|two"
    assert sorted(got[1].lower().split("|")) == ["", "a", "b", "c", "d"]
    assert "Generate" not in _plan(out)


def test_index_of_each_text(spark, docs):
    """Rows of one id were merged before."""
    out = q_domain.SRC06_inverted_index(spark, docs)
    assert {(r.id, r.abstract) for r in out.where("abstract is not null").collect()} == {(1, "b A a  B a c"), (1, "C d"), (3, ""), (4, "one two one")}
    assert out.where("id = 2").collect()[0].abstract is None and "Exchange" not in _plan(out)


def test_words_are_hashed_once(spark):
    """The hashes stood inside the loop over the vector's places before."""
    made = str(vectors.hashed_bag(8)(F.lit("a b")))
    assert made.index("md5(") < made.index("sequence(")


def test_union_is_made_distinct_once(spark, tmp_path):
    spark.createDataFrame([("A", 1, 2), ("R", 1, 2), ("N", 5, 5), ("R", 3, 4)], "l_returnflag string, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = q_identity.SET01_union(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(1, 2), (3, 4)} and _plan(q_identity.SET01_union(spark, str(tmp_path))).count("HashAggregate") == 2


def test_pairs_are_not_shuffled(spark):
    """Neighbours in common were counted after a shuffle of all pairs before."""
    edges = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, 8), (3, 8), (3, 8), (4, 9), (None, 8), (2, None)], "s long, p long")
    out = graph.shared_neighbours(edges, "s", "p")
    assert "hashpartitioning(b" not in _plan(out) and "hashpartitioning(a#" in _plan(out) and ", b#" not in "".join(x.split("\n")[0] for x in _plan(out).split("hashpartitioning(")[1:])
    got = {(r.a, r.b): (r.common, r.adamic_adar, r.salton) for r in out.collect()}
    assert got == {(1, 2): (1, pytest.approx(0.910239), 0.5), (1, 3): (2, pytest.approx(2.352934), 1.0), (2, 3): (1, pytest.approx(0.910239), 0.5)}


def test_trigrams_are_not_broadcast(spark):
    """Joins with tables of trigrams were planned by the texts' size, and the driver held them."""
    items = spark.createDataFrame([(1, "a" * 30 + "b" * 20), (2, "a" * 30 + "b" * 19 + "c"), (3, "a" * 30 + "b" * 20), (4, None)], "key long, t string")
    out = similar.similar(items, "key", "t")
    assert "Broadcast" not in _plan(out)
    assert {tuple(r) for r in out.collect()} == {(1, 1, 1), (3, 1, 1), (2, 2, 1)}


def test_lengths_are_taken_before_pairs_meet(spark, tmp_path):
    """Both lengths were taken for each pair before."""
    rows = [(0, [3.0, 4.0], 1), (1, [4.0, 3.0], 1), (2, [0.0, 0.0], 1), (3, [1.0], 1), (4, [1.0, 0.0], 2), (5, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = q_ranking.VEC01_JON11_pairs(spark, str(tmp_path))
    plan = _plan(out).upper()
    assert "SQRT" in plan and "SQRT" not in plan[: plan.index("JOIN")]
    assert {tuple(r) for r in out.collect()} == {(0, 1, 0.96), (0, 2, 0.0), (0, 3, 0.0), (0, 5, 0.0)}


def test_recordings_meet_at_two_landmarks(spark):
    """op6: lists that share single landmarks are no candidates (all their pairs were), and no link that comparing all pairs finds is missed, drones and long lists included."""
    from evloom.llm import audio

    rng = np.random.default_rng(3)
    lists = []
    for k in range(60):
        x = rng.integers(1, 1 << 31, 112).astype(np.uint32)
        at = int(rng.integers(0, 100))
        x[at : at + 3] = (5, 6, 7)
        lists.append(x)
    assert audio.candidates(_prints(spark, lists)).count() == 0
    base = rng.integers(1, 1 << 31, 3000).astype(np.uint32)
    for n in (4, 30, 41, 112, 500, 2000):
        for noise in (0.3, 0.6, 0.75):
            x = base[200 : 200 + n].copy()
            x[rng.random(n) < noise] ^= np.uint32(1 << int(rng.integers(0, 31)))
            lists.append(x)
    for n in (50, 120, 900):  # few landmarks in many places
        x = np.full(n, 9, np.uint32)
        x[-4:] = base[300:304]
        lists += [x, np.resize(base[:3], n), np.concatenate([base[700:702], x])]
    found = {(r.a, r.b) for r in audio.candidates(_prints(spark, lists)).collect()}
    want = {(i, j) for j, q in enumerate(lists) for i, p in enumerate(lists[:j]) if audio.linked(p, q, errors=1.0)}
    assert len(want) > 60 and want <= found and all(a < b for a, b in found)


def test_recordings_meet_at_rare_landmarks(spark, monkeypatch):
    """op6: places of rare landmarks make no pairs within a list (a row for each two of them before); links by rare, by common and by both kinds are kept."""
    from evloom.llm import audio

    rng = np.random.default_rng(11)
    lists = [rng.integers(1, 1 << 31, 112).astype(np.uint32) for _ in range(40)]
    for k in range(0, 40, 2):  # each shares one stretch of 20 with the list after the next, none an offset with 6 landmarks of a third
        lists[(k + 2) % 40][60:80] = lists[k][20:40]
    # Lists of a few landmarks: linked by a rare and a common one, at a place that each has once or often.
    for k in range(12):
        x = rng.integers(1, 1 << 31, 24).astype(np.uint32)
        x[:3], x[10:13] = (5, 6, 7), (100 + k // 2, 6, 200 + k // 2)
        lists += [x, np.concatenate([x[:3], x[10:13]]), np.tile(x[10:13], 5)]
    want = {(i, j) for j, q in enumerate(lists) for i, p in enumerate(lists[:j]) if audio.linked(p, q, errors=1.0)}
    assert len(want) > 20
    made = []
    monkeypatch.setattr(audio, "materialise", lambda df, name: made.append((name, df := df.cache())) or df)
    for rare in (1, 3, 8, 99):
        monkeypatch.setattr(audio, "RARE", rare)
        out = audio.candidates(_prints(spark, lists))
        assert want <= {(r.a, r.b) for r in out.collect()}
    assert made[-1][0] == "stand" and made[-1][1].agg(F.max(F.size("l"))).first()[0] == 0 and made[-1][1].agg(F.max(F.size("shared"))).first()[0] > 30


def test_citations_meet_lists_of_questions(spark):
    """DEC12: a row for each citation and each question of its evidence was shuffled before."""
    from evloom.operators import gates

    make = spark.createDataFrame
    cand = make([(i, "boundary_gap", False) for i in range(1, 7)], "candidate int, gap_type string, contradicted boolean")
    asked = make([(1, 1), (1, 1), (2, 2), (3, 1), (3, None), (4, 1), (5, 1), (6, 1), (None, 1)], "candidate int, question_id int")
    cited = make([(1, 10), (1, 10), (1, 11), (2, 10), (3, 10), (4, None), (4, 99), (5, 11), (5, 13), (6, 11), (6, 12), (None, 10)], "candidate int, evidence_id int")
    offered = make([(10, 1, 7, "limitation"), (10, 3, 7, "limitation"), (11, 1, 8, "method"), (11, None, 8, "method"), (12, 2, 9, "method"), (13, 1, None, "method")], "evidence_id int, question_id int, paper_id int, evidence_type string")
    out = gates.validate_candidates(cand, asked, cited, make([(1,), (2,), (2,)], "question_id int"), offered)
    few = "INSUFFICIENT_CANDIDATE_PAPER_SUPPORT"
    assert {r.candidate: r.reject for r in out.collect()} == {1: None, 2: "EVIDENCE_NOT_LINKED_TO_CITED_QUESTION", 3: "UNKNOWN_QUESTION_ID", 4: "UNKNOWN_EVIDENCE_ID", 5: few, 6: "CANDIDATE_LACKS_LIMITATION_SIGNAL"}
    assert "arrays_overlap" in _plan(out) and "Expand" not in _plan(out)


def test_evidence_carries_its_questions(spark, tmp_path):
    """RPT06: lines were numbered three times, links were a table of their own, and the text was shuffled; rows of one id share their questions, null ids have none."""
    from evloom.operators import briefs

    row = lambda task, place, i, asked: (task, place, i, 5, "method", None, "", "{}", None, asked)
    kind = "task int, place int, evidence_id int, paper_id int, type string, claim string, section string, conditions string, status string, asked array<int>"
    rows = [row(1, 2, 7, [4, None]), row(1, 1, 8, []), row(2, 1, 7, [11, 4]), row(2, 2, None, [3]), row(None, 1, 9, None)]
    links = spark.createDataFrame([(8, "x"), (8, None), (7, "b"), (None, "y"), (99, "z")], "evidence_id int, question_id string")
    got = {r.task: [x.split("  Linked questions: ")[1:] for x in r.block.split("- Evidence ID")[1:]] for r in briefs.evidence_block(spark.createDataFrame(rows, kind), links).collect()}
    assert got == {1: [["x\n"], ["11, 4, b"]], 2: [["11, 4, b\n"], []], None: [[]]}
    spark.createDataFrame([(1, 5, 1, 1, 1.0, 1.0, "d", "A", "F")], "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate string, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    from evloom.plans import q_reports

    plan = _plan(q_reports.RPT06_evidence_block(spark, str(tmp_path)))
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_matching_follows_the_evidence(spark, monkeypatch):
    """JDG01: tasks were as few as the packed bytes allowed, and one's memory grew with the rows."""
    from evloom.operators import judgements

    monkeypatch.setattr(judgements, "ROWS", 10)
    questions = spark.createDataFrame([(i, f"q{i}", "method") for i in range(5)], "question_id int, question string, question_type string")
    evidence = spark.createDataFrame([(i % 5, i, "method", "c") for i in range(95)], "question_id int, evidence_id int, evidence_type string, claim string")
    requests, numbered = judgements.match_requests(questions, evidence)
    assert numbered.rdd.getNumPartitions() == 10 and requests.count() == 5
    assert {(r["question_id"], r["batch"], r["index"], r["evidence_id"]) for r in numbered.collect()} == {(i % 5, 0, i // 5 + 1, i) for i in range(95)}
    out = judgements.match(questions, evidence, lambda asked: asked.select("question_id", "batch", F.lit('{"matches": [{"index": 2, "relation": "supports", "relevance": 0.5}]}').alias("raw")))
    assert sorted((r.question_id, r.evidence_id) for r in out.collect()) == [(i, i + 5) for i in range(5)]
    assert judgements.match_requests(questions, evidence.limit(0))[1].count() == 0


def _prints(spark, lists):
    return spark.createDataFrame([(k, x.view(np.int32).tolist()) for k, x in enumerate(lists)], "class_id long, prints array<int>")


def test_nearest_are_kept_as_they_are_met():
    """VEC04, GRF05, GRF06: of a block only what reaches the k best so far is sorted; ties by place, own row left out, bounds kept."""
    rng = np.random.default_rng(2)
    b = rng.normal(size=(700, 6))
    b[300:400] = b[5]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    a, own = b[:40], np.where(np.arange(40) % 2, np.arange(40), -1)
    bound = np.where(np.arange(40) % 3, -2.0, 0.9)
    row, col, sim = vectors._best(a, b, 5, own, bound)
    for i in range(40):
        s = (a[i] @ b.T).round(6)
        want = sorted((-x, j) for j, x in enumerate(s) if j != own[i] and x >= bound[i])[:5]
        assert col[row == i].tolist() == [j for _, j in want] and sim[row == i] == pytest.approx([-x for x, _ in want], abs=2e-6)


def test_greedy_in_fronts(spark, monkeypatch):
    """DED14: no pairs are stored; the same rows as one by one, with fronts and blocks of a few rows, nulls in order and vectors of several lengths."""
    from evloom.operators import identity

    for name, n in (("FRONT", 37), ("BLOCK", 50), ("ROWS", 8)):
        monkeypatch.setattr(identity, name, n)
    rng = np.random.default_rng(8)
    vecs = [rng.normal(size=3 + i % 2).tolist() for i in range(300)] + [None, [], [0.0] * 3]
    known, kept = vecs[:4], []
    like = lambda x, y: bool(x) and bool(y) and len(x) == len(y) and any(x) and any(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.8
    for i, v in enumerate(vecs[4:]):
        if not any(like(v, x) for x in known):
            known.append(v)
            kept.append(i)
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(vecs[4:])], "pos int, id int, vec array<double>").repartition(3)
    old = spark.createDataFrame([(v,) for v in vecs[:4]], "vec array<double>")
    assert [r["id"] for r in identity.greedy_semantic(df, old, 0.8).collect()] == kept


def test_corpus_neighbours_follow_the_pairs(spark, monkeypatch):
    """DEC15: tasks follow the number of pairs, so that one's memory doesn't; the same rows as a plain join, nulls included."""
    from evloom.operators import coverage

    monkeypatch.setattr(coverage, "PAIRS", 10)
    asked = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (2, 5, 1), (3, None, 1), (None, 5, 1)] + [(10 + i, 7, 2) for i in range(20)], "c int, g int, m int")
    members = spark.createDataFrame([(5, 1, 100), (5, 1, 101), (6, 1, 100), (None, 1, 102), (5, 1, None)] + [(7, 2, i) for i in range(15)], "g int, m int, p int")
    own = spark.createDataFrame([(1, 101), (10, 3), (None, 100)], "c int, p int")
    got = coverage.neighbours(asked, members, own, ["g", "m"])
    plain = asked.join(members, ["g", "m"]).select("c", "p").distinct().join(own, ["c", "p"], "left_anti")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(got) == rows(plain) and got.count() > 300
    assert got.rdd.getNumPartitions() == 31  # 310 pairs


def test_brief_reads_each_relation_once(spark):
    """Customers are read as tasks and steps (twice), orders and lines once for each relation and twice for evidence; rows that are paper, role and evidence give what three relations give."""
    d = "/root/testdata/sf0.001"
    out = q_reports.RPT01_landscape_brief(spark, d)
    assert _plan(out).count("FileScan parquet") <= 11
    tasks = spark.createDataFrame([(1, None, None), (2, "T", "over")], "task int, topic string, explanation string")
    found = spark.createDataFrame(
        [(1, 7, "high", "survey", 1, "limitation", "a\nb", None), (1, 7, None, "bench", 2, "result", "c", None), (1, 8, "low", None, 3, "future_work", None, "rejected"), (1, None, None, "bench", 4, "limitation", None, None), (9, 5, "high", "survey", 5, "limitation", "x", None)],
        "task int, paper_id int, priority string, role string, evidence_id int, type string, claim string, status string",
    )
    none = lambda schema: spark.createDataFrame([], schema)
    questions, coverage, steps = none("task int, question_id int, question string, importance double, status string"), none("question_id int, round int, score double, unavailable string, quality double, saturation string"), none("task int, place int, step string")
    gaps = spark.createDataFrame([(2, 6, 1, 1, 2, "surviving", False, "g", "P", None, None, None, None), (2, 7, 2, 1, 3, "odd", None, None, None, None, None, None, None)], "task int, gap_id int, canonical int, version int, created int, status string, complete boolean, description string, nearest string, residual string, confidence string, stability double, families double")
    plans = spark.createDataFrame([(6, "p1", None, None, "e1", None, None), (6, "p2", "", None, None, None, None), (7, "p3", None, None, None, None, None)], "gap_id int, " + ", ".join(f"{c} string" for c, *_ in briefs.PLAN))
    one = {r.task: r.brief for r in briefs.brief(tasks, questions, coverage, found, None, None, gaps, plans, steps).collect()}
    three = briefs.brief(tasks, questions, coverage, found.select("task", "paper_id", "priority"), found.select("task", "role"), found.select("task", "evidence_id", "paper_id", "type", "claim", "status"), gaps, plans, steps)
    assert one == {r.task: r.brief for r in three.collect()}
    assert "入库论文 4 篇，其中完成评分 2 篇（高优先级 1 篇），已抽取证据覆盖 2 篇。\n\n另有 2 篇" in one[1] and "论文角色分布：bench: 2，survey: 1。" in one[1] and "- [limitation] a b\n- [limitation] \n\n" in one[1] and briefs.NO_GAPS in one[1]
    assert "入库论文 0 篇" in one[2] and briefs.NO_LIMITS in one[2] and "论文角色" not in one[2] and "候选 Gap 共 2 个：存活 1，被驳回 0" in one[2] and one[2].count("- [存活][B(摘要级)] g") == 1
    assert "待验证现象: p1\n  - 待验证现象: p2\n  - 证伪实验: \n  - 证伪实验: e1\n- [odd]" in one[2] and "p3" not in one[2]
    assert one[9] == "论文角色分布：survey: 1。\n\n- [limitation] x\n"


@pytest.mark.parametrize("percent", [95, 80])
def test_texts_meet_without_being_shuffled_by_gram(spark, percent):
    """Each trigram of a prefix was a row that held the text and the whole prefix before. Texts here share a passage, repeat grams and differ by as much as is allowed, or by one edit more."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghé😀") for _ in range(n))
    passage, texts = word(40), ["a" * 44, "a" * 46, "ab" * 21, "ab" * 22]
    for n in (4, 5, 8, 10, 19, 20, 21, 39, 40, 41, 61, 80):
        t = passage[: n // 2] + word(n - n // 2)
        most = (n * (100 - percent) - 1) // 100
        for edits in (most, most + 1):
            changed = list(t)
            for at in rng.sample(range(n), edits):
                changed[at] = rng.choice(["#", ""])
            texts.append("".join(changed))
        texts.append(t)
    texts = list(dict.fromkeys(texts))
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        if 100 * abs(len(a) - len(b)) < (100 - percent) * max(len(a), len(b)) and 100 * (k := distance(a, b)) < (100 - percent) * max(len(a), len(b)):
            want[i, j] = k
    out = similar.links(spark.createDataFrame(list(enumerate(texts)), "rep long, t string"), percent)
    assert "Generate" not in _plan(out)
    assert {(r.a, r.b): r.distance for r in out.collect()} == want and len(want) > 5


def test_pairs_meet_semantic_ones_where_they_are_counted(spark, monkeypatch):
    """All citation pairs were shuffled and sorted for a full join with the semantic ones before."""
    monkeypatch.setattr(graph, "MET", 1, raising=False)
    rows = [(1, 7), (2, 7), (3, 7), (1, 8), (3, 8), (3, 8), (4, 9), (None, 8), (2, None)]
    edges = spark.createDataFrame(rows, "s long, p long")
    semantic = spark.createDataFrame([(1, 2, 0.5), (2, 9, 0.25), (3, 4, -0.5)], "a int, b int, sim double")
    out = graph.fused_edges(edges, "s", "p", semantic)
    assert "FullOuter" not in _plan(out) and "Exchange hashpartitioning(b" not in _plan(out)
    want = {(r.a, r.b): r.sim for r in graph.fused(graph.shared_neighbours(edges, "s", "p"), semantic).collect()}
    got = [tuple(r) for r in out.collect()]
    assert {(a, b): pytest.approx(sim) for a, b, sim in got} == want and len(got) == len(want) == 5
    assert {(r.a, r.b) for r in graph.fused_edges(edges.limit(0), "s", "p", semantic).collect()} == {(1, 2), (2, 9), (3, 4)}
