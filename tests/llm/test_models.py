"""Mined URL rules, class probabilities, token files and recordings against brute force."""

import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evloom.llm import audio, brown, tokenfile, urlrules

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens_of(url):
    if url is None or "://" not in url:
        return set()
    rest = url.split("://", 1)[1].split("#")[0]
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    out = {f"h:{x}" for x in host.lower().split(".")} | {"p:" + "".join("#" if c.isdigit() else c for c in x) for x in path.split("/")} | {f"q:{x.partition('=')[0]}" for x in query.split("&")}
    return {x for x in out if len(x) > 2}


def test_rules_brute(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        a, b, c = (int(x) for x in rng.integers(0, 4, 3))
        bad = rng.random() < (0.9 if a == 1 and b == 2 else 0.2)
        rows.append((f"http://s{'abcd'[a]}.io/{'wxyz'[b]}/deep/down/path/{'klmn'[c]}?v=1", bool(bad)))
    rows += [(None, True), (None, None)]
    found = urlrules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    sets = [(tokens_of(u), b) for u, b in rows if b is not None]
    base = sum(b for _, b in sets) / len(sets)
    names = sorted(set().union(*(s for s, _ in sets)))
    where = {t: frozenset(i for i, (s, _) in enumerate(sets) if t in s) for t in names}
    first = [t for t in names if t == min(x for x in names if where[x] == where[t])]
    want = set()
    for n in (1, 2, 3, 4):
        for combo in itertools.combinations(first, n):
            at = frozenset.intersection(*(where[t] for t in combo))
            k = sum(sets[i][1] for i in at)
            if len(at) >= urlrules.LEAST_URLS and k / len(at) >= base * urlrules.LIFT and (k / len(at) - base) * math.sqrt(len(at) / (base * (1 - base))) >= urlrules.SIGMAS:
                want.add(frozenset(combo))
    assert {frozenset(r["antecedent"]) for r in found.collect()} == want and want
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(0, rows[0][0])], "page_id long, url string")
    got = urlrules.judge(pages, spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r["verdict"] == "block") == any(x <= tokens_of(rows[r["page_id"]][0]) for x in want)
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    assert urlrules.mine(spark.createDataFrame([], "url string, bad boolean")) is None


def test_class_probabilities(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 20)
    monkeypatch.setattr(brown, "KNOWN", 60)
    rng = np.random.default_rng(9)
    words = [f"w{k}{'ab'[k % 2]}z" for k in range(150)]
    texts = [" ".join(rng.choice(words, 30, p=np.arange(150, 0, -1) / 11325)) for _ in range(80)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = brown.ClassModel(df)
    known = {w: i for i, (w, _) in enumerate(m.top)}
    assert len(m.top) == 60 and (m.kind[brown.HEAD : -1] != np.array([m.group[brown.open_group(w)] for w, _ in m.top[brown.HEAD :]])).any()
    count = Counter(w for t in texts for w in brown.tokens((t or "").encode()))
    cls = lambda w: m.kind[known[w]] if w in known else m.group[brown.open_group(w)]
    # All words, the end, and one unknown word for each class, after any class.
    emit = np.bincount([cls(w) for w in count], weights=[n + 0.5 for n in count.values()], minlength=brown.CLASSES)
    emit[brown.CLASSES - 1] += len(texts) + 0.5
    assert (10**m.step @ ((emit + 0.5) / 10**m.under)) == pytest.approx(np.ones(brown.CLASSES))
    line = [cls(w) for t in texts for w in brown.tokens((t or "").encode())]
    assert m.under == pytest.approx(np.log10(np.bincount(line + [brown.CLASSES - 1] * len(texts), minlength=brown.CLASSES) + 0.5 * (np.bincount([cls(w) for w in count] + [brown.CLASSES - 1], minlength=brown.CLASSES) + 1)))
    probe = ["w0az w1bz W2AZ never w149bz", None, texts[3]]
    got = {r["doc_id"]: r for r in brown.score(spark.createDataFrame(list(enumerate(probe)), "doc_id long, text string"), df).collect()}
    for i, t in enumerate(probe):
        want, before = 0.0, brown.CLASSES - 1
        for w in [*brown.tokens((t or "").encode()), None]:
            c, n = (brown.CLASSES - 1, len(texts)) if w is None else (cls(w), count[w])
            want += m.step[before, c] + math.log10(n + 0.5) - m.under[c]
            before = c
        assert got[i]["score"] == pytest.approx(want)


def test_token_files_whole(spark):
    """Every start, count and checksum, with very long, empty, null and repeated rows and ids of another type."""
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    texts = ["word " * 200_000 + "<|endoftext|>", "", None, " ", "é中\n\n x", *(" ".join(f"t{x}" for x in rng.integers(0, 900, 300)) for _ in range(40))]
    rows = [(f"d{k:03}", t) for k, t in enumerate(texts)] + [("d004", texts[4]), (None, "none")]
    got = tokenfile.token_file_digest(spark.createDataFrame(rows, "doc_id string, text string"), PATH).collect()
    at = 0
    for r, (doc, t) in zip(sorted(got, key=lambda r: r["start"]), sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.token_file_digest(spark.createDataFrame(rows[:1], "doc_id string, text string").limit(0), PATH).count() == 0


def test_coder_beats_order_0():
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 300, (300, 3))
    ids = [0]
    for k in rng.integers(0, 4, 60_000).tolist():
        ids.append(int(follow[ids[-1], k]) if k < 3 else int(rng.integers(0, 300)))
    ids = np.array(ids, np.uint32)
    block = tokenfile.encode_block(ids)
    assert (tokenfile.decode_block(block) == ids).all()
    share = np.bincount(ids) / len(ids)
    assert len(block) * 8 / len(ids) < 0.85 * -(share[share > 0] * np.log2(share[share > 0])).sum()
    for odd in (np.zeros(0, np.uint32), np.array([65535]), np.array([7] * 5000), np.arange(3000) % 65536):
        assert (tokenfile.decode_block(tokenfile.encode_block(odd)) == odd).all()


def test_coder_cost():
    """Coding and decoding an id together cost less than 400 passes of an addition and a lookup over as many numbers; the size stays near order 0's entropy where nothing follows from what came before."""
    rng = np.random.default_rng(5)
    ids = (np.minimum(rng.zipf(1.3, 1 << 19), 3000) * 21).astype(np.uint32)
    lanes = np.arange(4096)

    def passes():
        for _ in range(len(ids) // len(lanes)):
            for _ in range(100):
                (lanes + lanes).take(lanes)

    def seconds(run, *args):
        before = time.process_time()
        return run(*args), time.process_time() - before

    cost = []
    for _ in range(3):
        block, coding = seconds(tokenfile.encode_block, ids)
        back, decoding = seconds(tokenfile.decode_block, block)
        assert (back == ids).all()
        cost.append((coding + decoding) / seconds(passes)[1])
    assert min(cost) < 4
    share = np.bincount(ids) / len(ids)
    assert len(block) * 8 / len(ids) < 1.15 * -(share[share > 0] * np.log2(share[share > 0])).sum()
    every = np.concatenate([np.arange(1 << 16), np.arange(1 << 16)[::-1]]).astype(np.uint32)
    assert (tokenfile.decode_block(tokenfile.encode_block(every)) == every).all()
    with pytest.raises(ValueError):
        tokenfile.encode_block(np.array([1 << 16], np.uint32))


def test_recordings_brute(spark):
    """Every pair compared: drones, silence, shifts that are no multiple of the hop, noise, excerpts, repeats, null."""
    rng = np.random.default_rng(7)
    tunes = [audio.melody(rng.normal(0, 0.12, 96)) for _ in range(4)]
    tone = lambda n, f=440: 0.5 * np.sin(2 * np.pi * f / audio.RATE * np.arange(n))
    sounds = [*tunes, *(x[64:] for x in tunes), *(x + rng.normal(0, 0.05, len(x)) for x in tunes), tunes[0][9000:30000], tone(90_000), tone(120_000), tone(90_000, 523), np.concatenate([tone(40_000), tunes[1]])]
    sounds += [np.zeros(30_000), np.zeros(60_000), np.concatenate([np.zeros(20_000), tunes[2]]), np.zeros(10), None]
    rows = [(k, None if x is None else x.astype("<f4").tolist()) for k, x in enumerate(sounds)]
    got = {r["media_id"]: r for r in audio.match(spark.createDataFrame([*rows, (99, rows[0][1])], "media_id long, samples array<float>")).collect()}
    prints = [audio.packed(audio.chroma(np.asarray([] if x is None else x, float))) for _, x in rows]
    want = [sum(1 for j, q in enumerate(prints) if j != i and len(p) and len(q) and not np.array_equal(p, q) and audio.linked(p, q)) for i, p in enumerate(prints)]
    assert [got[i]["n_links"] for i in range(len(rows))] == want
    assert all(got[i]["n_links"] >= 2 for i in range(4)) and got[99]["class_id"] == 0
    assert audio.match(spark.createDataFrame([], "media_id long, samples array<float>")).count() == 0
