"""The ten operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from evloom.llm import audio, bpe, brown, graph, langid, mixing, quality, simhash, tokencount, tokenfile, urlrules

PATH = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, target string, repeats int, label string"
TEXT = "The quick brown fox jumps over the lazy dog and the small bird sings a long song in the old green garden today."
ODD = ["", None, " ", "  a  b ", "x <|endoftext|> y\n\n z", "café 中文 \U0001f600 it's 12", "one\x0btwo\x1cthree four", TEXT, TEXT, TEXT + " More.", "word " * 40, "- - ! !", "Z" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["b", None, "a"][i % 3], None, "t", 1, "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [(None, TEXT, "en", "b", 1, None, None, None), (7, TEXT, "en", "b", 1, None, None, None)], KIND)


def test_bpe_matches_library(spark, docs):
    lib = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        e = lib.encode(r["text"] or "", add_special_tokens=False)
        want[r["doc_id"], len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.token_digest(docs, PATH).collect())) == want
    assert bpe.token_digest(docs.limit(0), PATH).count() == 0


def test_token_files(spark, docs):
    lib = Tokenizer.from_file(PATH)
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    got, at = sorted(map(tuple, tokenfile.token_file_digest(docs, PATH).collect()), key=lambda r: r[1]), 0
    assert len(got) == len(rows)
    for r, (doc, start, n, crc) in zip(rows, got, strict=True):
        assert start == at and doc == r["doc_id"]
        at += n
    one = next(r for r in got if r[0] == 5)
    ids = [*lib.encode(ODD[5], add_special_tokens=False).ids, 0]
    assert one[2:] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    block = bytearray(tokenfile.encode_block(np.arange(5000) % 77))
    assert (tokenfile.decode_block(bytes(block)) == np.arange(5000) % 77).all()
    block[-9] ^= 1
    with pytest.raises(ValueError):
        tokenfile.decode_block(bytes(block))


def test_token_counts(spark, docs):
    lib = Tokenizer.from_file(PATH)
    got = Counter()
    for r in tokencount.line_sections(docs.where("doc_id is not null and doc_id != 7"), PATH).collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert all(got[i] == len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD) if i != 7)
    edges = np.array([0, 3, 10])
    for rule, want in (("majority", [1, 2]), ("start", [2, 1]), ("share", [1 + 1 / 3, 1 + 2 / 3])):
        count, crossing = tokencount.attribute(np.array([0, 2, 5]), np.array([2, 5, 10]), edges, rule)
        assert count == pytest.approx(want) and crossing.sum() >= 1


def test_simhash_brute(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["aa", "Bb", "cc", "dd", "ee", "ff"], 60)) for _ in range(6)]
    texts = [*ODD, *base, *(b + " x" for b in base), *(b.lower() for b in base)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def fp(t):
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fp(t) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (want[i] ^ want[j]).bit_count() <= 2:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert [got[i]["fp"] % 2**64 for i in range(len(texts))] == want
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hot_signatures_link(spark):
    """More than HOT fingerprints under one variant: linked as by comparing all."""
    fps = sorted({int(1 << i | 1 << j) for i in range(12) for j in range(i)} | {0, 1 << 40})
    edges = simhash._links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    label = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert len({label.get(f, f) for f in fps}) == 1


def test_language(spark, docs):
    rows = [(i, t, k) for i in range(60) for k, t in (("en", "the house and the garden"), ("de", "das haus und der garten"))]
    df = spark.createDataFrame([(n, t, k) for n, (_, t, k) in enumerate(rows)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "gardening housed", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[n]["lang_pred"] == k for n, (_, _, k) in enumerate(rows))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    kept = langid.language_filter(df)
    assert kept.count() == len(rows) + 1 and kept.columns == df.columns
    assert langid.identify(df.limit(0)).count() == 0


def test_class_lm(spark, docs):
    got = brown.score_held_out(docs).collect()
    train = [r["text"] for r in docs.collect() if zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 != 1]
    c = Counter(w for t in train for w in [*brown.tokens((t or "").encode()), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == docs.count() and {r["train_tokens"] for r in got} == {n}
    for r in got:
        text = ODD[r["doc_id"]] if r["doc_id"] is not None else TEXT
        tok = [*brown.tokens((text or "").encode()), None]
        assert r["n_tokens"] == len(tok) and r["n_known"] == sum(c[t] > 0 for t in tok)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tok))
        assert r["score"] < 0
    assert brown.score_held_out(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    rows = mixing.mixing_digest(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        a = by.setdefault((r["source_size"], r["target"]), [0, 0])
        a[0], a[1] = a[0] + r["taken"], max(a[1], r["size"])
    assert all(abs(t - got) <= most for (_, t), (got, most) in by.items())
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by))
    assert mixing.mixing_digest(docs.limit(0)).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality.judge(docs, "doc_id").collect() if r["doc_id"] is not None}
    for i, t in enumerate(ODD):
        w = (t or "").encode().split()
        g = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(g)
        cover = {p for k, x in enumerate(g) if n[x] > 1 for p in range(k, k + 8)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(cover)), t
    assert not got[10]["kept"] and got[7]["kept"]
    assert quality.judge(docs.limit(0), "doc_id").count() == 0


def test_url_rules(spark):
    urls = ["http://A.example.net/en/1", "https://x.net", "http://y.org/fr/a?b", "nothing", None, "http://bad.site.io/win/1", "http://good.site.io/read/2", "http://example.com/de/#x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://bad.site{i}.io/win/{i}", True) for i in range(40)] + [(f"http://good.site{i}.io/read/{i}", False) for i in range(60)] + [(None, None)], "url string, bad boolean")
    got = {r["page_id"]: r for r in urlrules.judge(pages, labelled).collect()}
    assert [got[i]["rule"] for i in range(8)] == ["example.net/en/", None, "org/fr/", None, None, None, None, "example.com/de/"]
    assert [got[i]["verdict"] for i in range(8)] == ["allow", "allow", "allow", "allow", "allow", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[3]["host"]) == ("a.example.net", "/en/1", "")


def test_audio(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 0.12, 64), rng.normal(0, 0.12, 64)
    rows = [(1, a.tolist()), (2, a.tolist()), (3, b.tolist()), (4, a[8:].tolist()), (5, None), (6, [])]
    got = {r["media_id"]: r for r in audio.match(spark.createDataFrame(rows, "media_id long, samples array<double>"), audio.melody).collect()}
    assert [got[i]["class_id"] for i in range(1, 7)] == [1, 1, 3, 4, 5, 6]
    assert got[1]["best_class"] == 4 and got[3]["n_links"] == 0 and got[4]["best_offset"] == -16 or got[4]["best_offset"] == 16
