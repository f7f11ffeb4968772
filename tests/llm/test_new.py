"""Whitening, pieces and conversation repair against brute force and the library, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from evloom.llm import convrepair, piece, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "▁", "a▁b", "▁▁ a", "\n\n x\t y", "café 中文 \U0001f600 it's 12345", "x" * 300, "中文字" * 200, " " * 70, "<s> </s> <unk> <0x41>", "\0a\0", "ﬁ ① ⅷ ㍿ ｆｕｌｌ　x", "   lead", "trail   ", "a　b", "Z" * 300_000, " x" * 50_000, "the same text twice.", "the same text twice."]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def noise(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice("ab e▁ \n.\U0001f600é中①ﬁ　th") for _ in range(rng.randint(1, 60))) for _ in range(n)]


# --- pieces ---


def test_pieces_match_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, *noise(300)])] + [(None, "a b", None, None), (7, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode()), len((t or "").encode())] += 1
    assert Counter(map(tuple, piece.piece_digest(docs, MODEL).collect())) == want
    assert piece.piece_digest(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("trim", "prefix"), list(itertools.product([True, False], repeat=2)))
def test_pieces_with_character_maps(tmp_path, rule, trim, prefix):
    """The library's own maps in this model: ids, decoded texts and source bytes of each piece."""
    spec, norm = proto.ModelProto(), proto.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec.normalizer_spec.CopyFrom(norm.normalizer_spec)
    spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.escape_whitespaces = trim, prefix, True
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=path), piece.PieceEncoder(path)
    texts = [t or "" for t in ODD[:18]] + noise(400)
    normal, places = enc.normalised([t.encode() for t in texts])
    flat, edges = enc.encode_all(normal)
    for k, t in enumerate(texts):
        ids = flat[edges[k] : edges[k + 1]]
        spans = _library_spans(lib, t)
        begin, stop = enc.spans(ids, normal[k], places and places[k])
        assert ids.tolist() == lib.encode(t) and list(zip(begin.tolist(), stop.tolist(), strict=True)) == spans, t
        assert enc.model.decode(ids.tolist()) == lib.decode(ids.tolist()), t


def _library_spans(lib, text):
    from sentencepiece import sentencepiece_pb2

    found = sentencepiece_pb2.SentencePieceText()
    found.ParseFromString(lib.encode(text, out_type="serialized_proto"))
    return [(p.begin, p.end) for p in found.pieces]


def test_piece_spans(spark):
    docs = spark.createDataFrame([(1, "é 中文\U0001f600x", 9), (2, None, 9)], "doc_id long, text string, starts int")
    one, none = sorted(piece.encode(docs, MODEL, "doc_id").collect())
    raw = "é 中文\U0001f600x".encode()
    assert b"".join(raw[a:b] for a, b in zip(one.starts, one.stops, strict=True)) == raw and one.decoded == raw.decode()
    assert none.ids == [1, 2] and none.starts == none.stops == [0, 0] and none.decoded == ""


# --- whitening ---


def _whiten_brute(rows, top=4):
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array(sorted({tuple(v) for _, v in good}))
    n, s = len(x), x.sum(axis=0)
    gap = x - x.mean(axis=0)
    values, q = np.linalg.eigh(gap.T @ gap / n)
    values, q = values[::-1], q[:, ::-1]
    return {(i, k + 1): (n, int(((n * v - s).astype(object) ** 2).sum()), abs(float((v - s / n) @ q[:, k]) / values[k] ** 0.5), values[k] / values.sum()) for i, v in good for k in range(top)}


def test_whitening_brute(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 9)) * np.linspace(2, 0.3, 9)).astype("float32").tolist()
    rows = [*enumerate(base), *((1000 + k, base[7]) for k in range(400)), (2000, None), (2001, [*base[0][:8], None]), (2002, [*base[0][:8], float("nan")]), (2003, [*base[0][:8], float("-inf")])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(7)
    want, got = _whiten_brute(rows), whitening.whiten_digest(df).collect()
    assert len(got) == len(want) == 4 * 700
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(white, rel=1e-9, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
    signs = {(r.component): np.sign(r.whitened) for r in got if r.vec_id == 3}
    assert set(signs) == {1, 2, 3, 4}
    assert whitening.whiten_digest(df.limit(0)).collect() == []


def test_whitening_degenerate(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [0.25]), (4, [0.75]), (5, [])], "vec_id long, embedding array<float>")
    got = sorted(whitening.whiten_digest(df).collect(), key=lambda r: (r.vec_id or 0, r.component))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [(None, 1, 2, 16384), (1, 1, 1, 0), (1, 2, 1, 0), (2, 1, 1, 0), (2, 2, 1, 0), (4, 1, 2, 16384)]
    assert [r.whitened for r in got] == [-1.0, None, None, None, None, 1.0] and [r.explained for r in got] == [1, 0, 0, 0, 0, 1] and not any(r.identity_error for r in got)
    far = spark.createDataFrame([(k, [1e16 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten_digest(far).collect()] == [None] * 4


def test_moments_merge():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 5)) + 1e6
    whole, parts = whitening.Moments(5), whitening.Moments(5)
    for v in x:
        whole.add(v)
    for part in np.split(x, [0, 1, 60, 61]):
        m = whitening.Moments(5)
        for v in part:
            m.add(v)
        parts.merge(m.n, m.total, m.mean, m.scatter)
    for m in (whole, parts):
        assert m.n == 200 and np.allclose(m.scatter / 200, np.cov(x.T, bias=True), rtol=1e-8, atol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 40])
def test_symmetric_qr(d):
    x = np.random.default_rng(d).normal(size=(90, d)) * np.linspace(1, 5, d)
    for a in (np.atleast_2d(np.cov(x.T)), np.zeros((d, d)), np.eye(d), np.ones((d, d))):
        values, q = whitening.symmetric_qr(a)
        assert np.allclose(a @ q, q * values, atol=1e-12 * max(1, np.abs(a).max())) and np.allclose(q.T @ q, np.eye(d), atol=1e-13) and (np.diff(values) <= 0).all()


# --- conversations ---


def _best(rows):
    """(cost, audit, turns) by trying every sequence of edits, by way of the grammar as a pattern."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    found = []

    def go(at, cost, audit, turns, inserted):
        if cost > limit:
            return
        if at == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found.append((cost, audit, turns))
        else:
            _, role, text = rows[at]
            go(at + 1, cost + 4, audit + "D", turns, 0)
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] else 0
                go(at + 1, cost + more, audit + "K", [*turns, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(at + 1, cost + 3 + more, audit + "R", [*turns, (to, text)], 0)
        if inserted < 2:
            for to in ("user", "assistant"):
                go(at, cost + 3, audit + "I", [*turns, (to, "")], inserted + 1)

    for limit in range(0, 4 * len(rows) + 1):
        go(0, 0, "", [], 0)
        if found:
            break
    cost, audit, turns = min(found, key=lambda x: x[:2])
    return faults, cost, audit, turns


def _repair_brute(rows):
    out, by = {}, defaultdict(list)
    for key, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        how, role, text = zlib.crc32(f"{space(key)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        by[key] += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    for key, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, cost, audit, turns = _best(found)
        turn = {r[0] for r in found} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        counts = Counter(faults)
        out[key] = (max(turn) - min(turn) + 1 - len(turn) if turn else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns).encode()))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    texts = ["Hello there.", "And then?", "cut off", " \t", "", None, "Yes!", "End. \n", "é…"]
    rows = [(k, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(texts)) for k in [None, *range(120)] for _ in range(rng.randint(1, 5))]
    rows += [(500 + k, t, "user" if t % 2 else "assistant", "Fine.") for k in range(40) for t in range(2)]
    gone = [k for k in range(10**4, 10**4 + 200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    return rows + [(k, 0, "user", "x") for k in gone]


@pytest.mark.parametrize("long", [convrepair.LONG, 2])
def test_repair_brute(spark, talks, long, monkeypatch):
    """Whole conversations in one task, and the same in blocks of two rows."""
    monkeypatch.setattr(convrepair, "BLOCK", 1)
    df = spark.createDataFrame([(*r, 1) for r in talks], "conv_id long, turn long, role string, text string, cost int")
    hurt = convrepair.damaged(df)
    got = {r[0]: tuple(r[1:]) for r in convrepair.repair(hurt, hurt.gone, long=long).collect()}
    want = _repair_brute(talks)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    turns = defaultdict(list)
    for r in convrepair.repair(hurt, hurt.gone, turns=True, long=long).collect():
        turns[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for k in want:
        assert [p for p, _ in sorted(turns[k])] == list(range(len(turns[k]))) and sha("\n".join(t for _, t in sorted(turns[k])).encode()) == want[k][-1]


def test_repair_long_and_empty(spark):
    """A conversation of many rows in several blocks, against one pass over the whole of it."""
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "system", "odd"]), rng.choice(["A. ", "b", "", f"{k}!"]) + "w" * (k % 5)) for k in range(30_000)]
    df = spark.createDataFrame([*rows, (2, 1, "user", "Q" * 2_000_000 + "."), (2, 2, "assistant", "A.")], "conv_id long, turn long, role string, text string")
    blocks, plain = (sorted(convrepair.repair(df, long=n).collect()) for n in (20_000, 40_000))
    assert blocks == plain and blocks[1].audit == "KK" and len(blocks[0].audit) >= 30_000
    assert convrepair.repair_digest(df.limit(0)).collect() == []
