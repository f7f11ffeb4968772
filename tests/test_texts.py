"""Similarity join, page blocks and communities against brute force."""

import itertools
import random
from collections import Counter

from evloom.operators import blocks, louvain, similar


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_equals_all_pairs(spark):
    """Near copies in a family, a hot trigram in all texts, repeats, accents, and lengths at the edges of bands."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) + "zzzzzz" for n in [12, 13, 14, 20, 33, 34, 52, 53, 90, 140] for _ in range(3)]

    def edit(t):
        at = rng.randrange(len(t) + 1)
        return t[:at] + rng.choice(["", "q", "é"]) + t[at + rng.choice([0, 1]) :]

    texts = base + [edit(t) for t in base] + [edit(edit(edit(t))) for t in base] + base[:5] + ["", "", None, "a" * 60, "a" * 61, "a" * 63]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "id long, title string")
    rep = {}
    for i, t in rows:
        if t is not None:
            rep.setdefault(t, i)
    want = {(i, j): distance(a, b) for (a, i), (b, j) in itertools.combinations(rep.items(), 2) if 100 * distance(a, b) < 5 * max(len(a), len(b))}
    got = similar.links(df.where("title is not null").groupBy("title").agg({"id": "min"}).toDF("t", "rep"))
    assert {(r.a, r.b): r.distance for r in got.collect()} == want and len(want) > 20
    count = Counter(x for p in want for x in p)
    assert {tuple(r) for r in similar.similar(df, "id", "title").collect()} == {(i, rep[t], count[rep[t]]) for i, t in rows if t is not None}
    assert similar.similar(df.limit(0), "id", "title").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp;lt; one</title><script>var t="</p><h1>no</h1>";</script></head><body><nav><ul><li>Home<li>About</ul></nav>
<div class="top ad">Buy <div>now</div> cheap</div><article><H1>Related  <b>Work</b></H1><p>First<br>line <i>of</i> text<p>Second &lt;tag&gt; &amp;amp;<!-- <p>no --></p>
<h2>Introduction and background of a heading that is far too long to be one</h2><table><tr><td>cell 1<td>cell 2</tr></table>1 < 2</article><footer>End</footer></body></html>"""


def test_page_blocks(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text"), (None, "<p>x</p>")], "id long, html string")
    got = {}
    for r in sorted(blocks.page_blocks(df, "id", "html").collect(), key=lambda r: (r.id or 0, r.block)):
        got.setdefault(r.id, []).append((r.block, r.tag, r.level, r.depth, r.own, r.text))
    assert got[1] == [
        (0, "title", 0, 2, False, "T &lt; one"), (1, "li", 0, 4, False, "Home"), (2, "li", 0, 4, False, "About"), (3, "div", 0, 3, False, "Buy"), (4, "div", 0, 4, False, "now"), (5, None, 0, 3, False, "cheap"),
        (6, "h1", 1, 3, True, "Related Work"), (7, "p", 0, 3, True, "First line of text"), (8, "p", 0, 3, True, "Second <tag> &amp;"), (9, "h2", 2, 3, True, "Introduction and background of a heading that is far too long to be one"),
        (10, "td", 0, 5, True, "cell 1"), (11, "td", 0, 5, True, "cell 2"), (12, None, 0, 3, True, "1 < 2"), (13, "footer", 0, 3, False, "End"),
    ]
    assert got[4] == [(0, None, 0, 0, True, "plain text")] and got[None] == [(0, "p", 0, 0, True, "x")] and set(got) == {1, 4, None}
    streams = {r.id: r for r in blocks.page_streams(df.where("id is not null"), "id", "html").collect()}
    assert streams[1].stream.startswith("\n## Related Work\nFirst line of text Second") and streams[1].headings == 1 and not streams[1].scan
    assert all(streams[k].scan for k in (2, 3, 4)) and streams[2].stream == ""


def _sequential(n, edges):
    """Modularity of a plain one-thread search: moves of single nodes, then contraction."""
    weight = Counter()
    for a, b, w in edges:
        weight[min(a, b), max(a, b)] += w
    member, total = {i: i for i in range(n)}, 2 * sum(weight.values())
    while True:
        near = {}
        for (a, b), w in weight.items():
            near.setdefault(a, Counter())[b] += w
            near.setdefault(b, Counter())[a] += w
        degree = {i: sum(c.values()) for i, c in near.items()}
        at, size, moved = {i: i for i in near}, dict(degree), False
        while True:
            again = False
            for i in sorted(near):
                beside = Counter()
                for j, w in near[i].items():
                    if j != i:
                        beside[at[j]] += w
                size[at[i]] -= degree[i]
                best = max({*beside, at[i]}, key=lambda c: (total * beside[c] - degree[i] * size[c], c == at[i]))
                again |= best != at[i]
                at[i] = best
                size[best] += degree[i]
            moved |= again
            if not again:
                break
        if not moved:
            return member
        member = {i: at.get(c, c) for i, c in member.items()}
        folded = Counter()
        for (a, b), w in weight.items():
            folded[min(at[a], at[b]), max(at[a], at[b])] += w
        weight = folded


def test_louvain_planted(spark):
    rng = random.Random(7)
    n = 36
    edges = [(i, j, 0.5 + rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i // 9 == j // 9 else 0.04)]
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 99, None]], "id long")
    table = spark.createDataFrame([*edges, (3, 1000, 1.0), (1, None, 1.0), (0, 1, -2.0)], "a long, b long, sim double")
    labels = {r.node: r.label for r in louvain.louvain(nodes, table).collect()}
    assert set(labels) == {*range(n), 99} and labels[99] == 99
    assert all(label == min(i for i in labels if labels[i] == label) for label in labels.values())
    real = spark.createDataFrame(edges, "a long, b long, sim double")
    measure = lambda m: louvain.modularity(real, spark.createDataFrame(list(m.items()), "node long, label long"))
    found = measure(labels)
    assert found >= measure(_sequential(n, edges)) - 1e-9
    # No two communities would gain by merging.
    total, size, between = 2 * sum(w for *_, w in edges), Counter(), Counter()
    for a, b, w in edges:
        size[labels[a]] += w
        size[labels[b]] += w
        between[frozenset((labels[a], labels[b]))] += w
    assert all(total * w <= size[x] * size[y] + 1e-3 for k, w in between.items() if len(k) == 2 for x, y in [sorted(k)])
    assert louvain.louvain(nodes, table.limit(0)).count() == n + 1
