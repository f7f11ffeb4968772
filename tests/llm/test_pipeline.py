"""The pipeline's stages on planted rows, against brute force."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from evloom.llm import nearcopy

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, n):
    """words with n of them, far apart, replaced: each costs five shingles."""
    out = list(words)
    for k in rng.choice(np.arange(3, len(out) // 7), n, replace=False):
        out[7 * k] = f"new{rng.integers(1 << 40)}"
    return out


def sets(texts):
    cut = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()} for w in cut]


def groups(texts):
    s = sets(texts)
    comp = list(range(len(s)))
    near = [(i, j) for j in range(len(s)) for i in range(j) if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    for _ in s:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return comp


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(11)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    out = []
    for changes in (1, 2, 4, 6, 8, 9, 10, 11, 12, 14):  # Jaccard from 0.98 to 0.7 of 400 words
        base = prose(400)
        out += [base, edited(rng, base, changes)]
    hot = prose(300)  # more members than HOT, some of them near only to others than the least
    out += [edited(rng, hot, int(k)) for k in rng.integers(1, 6, 3 * nearcopy.HOT)]
    common = prose(60)
    out += [common + prose(200) for _ in range(2 * nearcopy.HOT)]
    return [" ".join(w) for w in out] + ["", None, " ", "a b", "A  b", "one two three four five"]


def test_near_dedup_brute(spark, planted):
    want = groups(planted)
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(planted)], KIND)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))
    assert len({want[2 * k + 1] != 2 * k + 1 for k in range(10)}) == 2  # planted pairs on both sides of 0.8
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_near_dedup_odd_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (3, "m n o p q r"), (3, "s t u v w x"), (2, "m n o p q r"), (None, "m n o p q r")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], KIND), "")
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(None, "a b c d e f"), (None, "g h i j k l"), (2, "m n o p q r"), (3, "s t u v w x")])


def test_rules_and_mix_judge_rows_by_themselves(spark):
    good = " ".join(f"word{k}" for k in range(30))
    rows = [(None, good + " one"), (None, "short"), (7, good + " two"), (7, "short"), (8, good + " three")]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], KIND)
    kept = corpus_pipeline.rules(spark, df, "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(x for x in rows if x[1] != "short")
    # One source whose target is its size: each row once, whatever its id.
    mixed = corpus_pipeline.mix(spark, df, "")
    assert mixed.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == Counter(rows)


def test_near_dedup_keeps_rows_that_differ_in_nulls(spark):
    """Hashes skip nulls: rows with the same values in other columns, and rows that differ in any other column, are rows of their own."""
    long = " ".join(f"v{k}" for k in range(40))
    rows = [(1, long, None, "a", 1), (1, None, long, "a", 1), (2, "", None, "a", None), (2, None, "", "a", None), (3, None, None, None, 3)]
    kept = nearcopy.keep_one(spark.createDataFrame(rows, KIND)).collect()
    # A text of its own each, but for those without shingles, which are alike.
    assert (1, long, None, "a", 1) in [tuple(r) for r in kept] and len(kept) == 2
    assert nearcopy._mark(spark.createDataFrame(rows, KIND)).select("h1", "h2").distinct().count() == len(rows)


def test_run_over_the_smallest_tables(spark):
    """Every row that run() gives is one of documents, encoded as the library does, and each stage leaves what the next one needs."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = False
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len({r.doc_id for r in got}) < len(text)
    for r in got:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


@pytest.mark.parametrize("name", ["op1_mixing", "op2_quality"])
def test_sql_of_native_operators(spark, name):
    import duckdb

    from evloom.llm import queries

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    mine = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(mine.columns)
    theirs = con.sql(f"select {', '.join(cols)} from ({queries.sql()[name]}) q").fetchall()
    plain = lambda rows: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in rows)
    assert plain(map(tuple, mine.select(*cols).collect())) == plain(theirs)


def test_near_dedup_links_by_simhash(spark, monkeypatch):
    """Pairs at two or fewer differing bits of SimHash are found by its index; near ones are joined by it and are not looked at again."""
    from evloom.llm import simhash

    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 900)]
    texts = [" ".join(base), " ".join([*base[:-1], "last"]), " ".join(["first", *base[1:]]), " ".join(f"v{x}" for x in range(50))]
    prints = [simhash.majority(nearcopy.shingles(t.encode())) for t in texts]
    bits = lambda i, j: ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count()
    met = {(r.a, r.b) for r in nearcopy._by_simhash(spark.createDataFrame(list(enumerate(prints)), "node long, fp long")).collect()}
    assert {j for _, j in met} == {j for j in range(1, 4) if any(bits(i, j) <= 2 for i in range(j))} == {1, 2} and all(bits(*p) <= 2 for p in met)
    seen, verify = [], nearcopy._verified
    monkeypatch.setattr(nearcopy, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verify(pairs, *rest))[1])
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], KIND), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and seen[0] == len(met)
    assert simhash.majority(np.zeros(0, np.uint64)) == 0
