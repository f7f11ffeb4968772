"""Pages, reports, communities and document sources on small tables."""

from pyspark.sql import functions as F

from evloom import sources
from evloom.operators import graph, pages, ranking, state

PAGE = "title string, content string, paper_ids array<string>, links array<string>, contradictions array<string>"


def test_merge_texts(spark):
    old = "intro\n\n## A\nx\ny\n\n## B\nz"
    cases = [
        (old, "## A\n y \nnew\n\nnew", "intro\n\n## A\nx\ny\n\nnew\n\n## B\nz"),
        (old, "## C\nq", old + "\n\n## C\nq"),
        (old, "## A\nx", old),
        ("## B\nz", "first", "first\n\n## B\nz"),
        ("## A\n1\n## A\n2", "## A\n2", "## A\n2"),
        (old, " \n", old),
        (None, None, None),
        (None, "## A\nx", "## A\nx"),
    ]
    kind = "title string, content string, paper_ids array<string>, links array<string>, contradictions array<string>"
    p = spark.createDataFrame([(str(k), o, None, None, None) for k, (o, _, _) in enumerate(cases)], kind)
    n = spark.createDataFrame([(1, str(k), n, None, None, None) for k, (_, n, _) in enumerate(cases)], "seq int, " + kind)
    got = {r["title"]: r["content"] for r in pages.merge_pages(p, n).collect()}
    assert [got[str(k)] for k in range(len(cases))] == [w for _, _, w in cases]


def test_merge_pages(spark):
    old = spark.createDataFrame([("p", "## A\nx", ["1"], ["l"], []), ("q", None, None, None, None)], PAGE)
    new = spark.createDataFrame([(2, "p", "## A\nw", ["2", "1"], None, ["c"]), (1, "p", "## A\nv\nx", None, ["m"], None), (1, "r", "## Z\nn", None, None, None)], "seq int, " + PAGE)
    got = {r["title"]: r for r in pages.merge_pages(old, new).collect()}
    assert got["p"]["content"] == "## A\nx\n\nv\n\nw" and got["p"]["paper_ids"] == ["1", "2"] and got["p"]["links"] == ["l", "m"] and got["p"]["contradictions"] == ["c"]
    assert not got["q"]["changed"] and got["r"]["content"] == "## Z\nn" and got["r"]["paper_ids"] == []
    assert pages.merge_pages(old.limit(0), new.limit(0)).count() == 0


def test_dispatch(spark):
    kind = "title string, type string"
    old = spark.createDataFrame([("memory models", "concept"), ("exact", "method"), ("xyz", "concept")], kind)
    acts = spark.createDataFrame([(1, "exact", "concept"), (2, "Models of memory", "concept"), (3, "Models of memory", "method"), (4, "qqq", "concept")], "id int, " + kind)
    assert {r["id"]: r["target"] for r in pages.dispatch(old, acts).collect()} == {1: "exact", 2: "memory models", 3: None, 4: None}


def test_context_budget(spark):
    rows = [("g", "method", "b", "m" * 400), ("g", "concept", "a", "c" * 400), ("g", "index", "i", "no"), ("h", "concept", "a", None)]
    p = spark.createDataFrame(rows, "g string, type string, title string, content string")
    got = {(r["g"], r["place"]): r["piece"] for r in pages.pack_context(p, "g", 1000).collect()}
    assert set(got) == {("g", 1), ("g", 2), ("h", 1)} and "[concept]" in got["g", 1]
    cut = {(r["g"], r["place"]): r["piece"] for r in pages.pack_context(p, "g", 800).collect()}
    assert cut["g", 2].endswith(pages.CUT_NOTE) and len(cut["g", 2]) == 800 - len(pages.CONTEXT_HEAD) - len(got["g", 1]) - 100 + len(pages.CUT_NOTE)
    assert ("g", 2) not in {(r["g"], r["place"]) for r in pages.pack_context(p, "g", 700).collect()}


def test_clusters_and_gaps(spark):
    whole = "ab" * 20
    p = spark.createDataFrame([("t", "## Summary of it\n s \n# Other\nx 0123abcd y", [whole, "cdcdcdcd", "ffffffff"])], "title string, content string, paper_ids array<string>")
    papers = spark.createDataFrame([(whole, "one"), ("cd" * 20, "two"), ("0123abcd" + "0" * 32, "three")], "id string, title string")
    r = pages.clusters(p, papers).collect()[0]
    assert (r["core_method"], r["limitations"], r["titles"]) == ("s", pages.NO_PART, ["one", "two", "three"])
    assert r["technique_details"].startswith("## Summary of it")
    full = p.withColumn("paper_ids", F.array(F.lit(whole)))
    assert pages.clusters(full, papers).collect()[0]["titles"] == ["one"]


def test_lint_needs_three_pages(spark):
    p = spark.createDataFrame([(1, "a", ["x"]), (1, "b", []), (1, "c", []), (2, "a", [])], "g int, title string, contradictions array<string>")
    issues = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z")], "g int, title string, description string")
    got = {(r["g"], r["title"]): r["contradictions"] for r in pages.lint(p, issues, "g").collect()}
    assert got[1, "a"] == ["x", "y"] and got[2, "a"] == [] and got[1, "b"] == []


def test_communities_and_fusion(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.9), (4, 5, 0.7)], "a int, b int, sim double")
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    got = {r["node"]: r["label"] for r in graph.communities(n, e, 5).collect()}
    assert got[1] == got[2] == got[3] and got[6] == 6 and got[1] != got[4]
    cite = spark.createDataFrame([(1, 2, 1.0, 0.5)], "a int, b int, adamic_adar double, salton double")
    f = {(r["a"], r["b"]): round(r["sim"], 6) for r in graph.fused(cite, e).collect()}
    assert f[1, 2] == round(0.6 * 0.75 + 0.4 * 0.9, 6) and f[4, 5] == 0.7


def test_sources(spark):
    t = spark.createDataFrame([([["h", None], ["a", "b"]],), ([["h"]],), (None,)], "rows array<array<string>>")
    got = [r[0] for r in t.select(sources.table_markdown(F.col("rows"))).collect()]
    assert got == ["\n[TABLE]\n| h |  |\n| --- | --- |\n| a | b |\n[/TABLE]\n", None, None]
    box = "x0 double, y0 double, x1 double, y1 double"
    b = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), [(0.0, 0.0, 2.0, 1.1)]), ((0.0, 0.0, 2.0, 2.0), [(0.0, 0.0, 2.0, 1.0)]), ((1.0, 1.0, 1.0, 2.0), [(0.0, 0.0, 9.0, 9.0)])], f"box struct<{box.replace(' double', ':double')}>, images array<struct<{box.replace(' double', ':double')}>>")
    assert [r[0] for r in b.select(sources.overlaps_image(F.col("box"), F.col("images"))).collect()] == [True, False, False]


def test_distribution(spark):
    df = spark.createDataFrame([("q", x) for x in (0.1, 0.5, 0.9)] + [("r", None)], "k string, x double")
    r = ranking.distribution(df, "k", "x").collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["lo"], r[0]["hi"], r[0]["p50"], r[0]["mean"]) == (3, 0.1, 0.9, 0.5, 0.5) and r[0]["hist"] == "0.1-0.2:1,0.5-0.6:1,0.9-1.0:1"


def test_cache_replay(spark):
    e = spark.createDataFrame([(1, t) for t in (0.0, 5.0, 9.0, 10.0, 12.0)] + [(2, 1.0)], "k int, s double")
    got = [r["hit"] for r in state.cache_replay(e, "k", "s", 10).where("k = 1").orderBy("s").collect()]
    assert got == [False, True, True, False, True]


def test_run_rounds():
    tries = []

    def step(n):
        tries.append(n)
        if n == 2 and tries.count(2) < 3:
            raise ValueError(f"try {tries.count(2)}")
        if n == 4:
            raise ValueError("same")

    assert state.run_rounds(step, 1, 5) == [(1, "done"), (2, "done"), (3, "done"), (4, "failed")]
    assert tries == [1, 2, 2, 2, 3, 4, 4, 4]
