"""Byte-level BPE by speculation and verification (operator 3).

A text is cut at spaces that stand before a non-space: pretokens never cross such a
place, so each segment is encoded on its own and remembered, in tables that a batch looks up at once.  For a new segment, greedy
longest match proposes tokens.  A token sequence is the BPE result exactly if each pair of
neighbours is *compatible* (merging the pair's bytes on their own gives the pair back), so all
distinct neighbouring pairs of a batch are tested at once against an array of known pairs.
Only segments with an incompatible pair run the exact merge loop.

Null and empty texts give no ids.  Special-token strings in a text become their ids, as the
library does by default.  Texts are never cut: memory follows the longest text of a batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evloom.llm.common import raw_text

#: Bytes that may follow a space where a text is cut: not ASCII white space, not a lead byte of any Unicode white space, not the mark 0.
#: That leaves some cuts out, so a segment may be too long but never too short.
CUTS = np.ones(256, bool)
CUTS[[0, *range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = False
#: The library's pretoken pattern with its classes \\p{L}, \\p{N} and \\s written out up to U+02AF.
LETTERS, NUMBERS, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANK}{LETTERS}{NUMBERS}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
BEYOND = re.compile("[^\\x00-ʯ]")
#: Words that a worker remembers; their bytes are bounded by LONG each. Frequent ones come first, so a full memory is left as it is.
REMEMBER = 200_000
#: Slots of the table of short segments, as a power of two; half of them are used at most.
SLOTS = 21
#: Segments of more than 15 bytes that a worker remembers, of up to LONG bytes each.
LONG_SEGMENTS = 50_000
#: Masks for the low 0 to 8 bytes of a 64-bit word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The rank of a pair that never merges.
NONE = 1 << 60
#: The same in arrays, where a rank shares 64 bits with a place.
NO_RANK = (1 << 31) - 1
#: Bytes up to which a word is merged together with others.
LONG = 64
#: Tested pairs that a worker remembers; beyond, it starts again.
PAIRS = 4_000_000


def sliced(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Runs of ids as little-endian unsigned 32-bit integers."""
    raw, stops = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def byte_chars() -> dict[str, int]:
    """Fixed values of the byte-level alphabet: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level files with the usual pattern, without normalizer and with plain added tokens, can be used")
        chars = byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in chars for c in t)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text in self.special:
            self.ids.pop(text.encode(), None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[raw(a), raw(b)] = rank
        self.single = [bytes([b]) for b in range(256)]
        self.pretokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.chars = chars
        #: Merges as arrays: sorted keys (left id << 32 | right id), their ranks, and by rank the id that results.
        pairs = np.array([(self.ids[a] << 32 | self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_keys, self.pair_ranks = np.append(pairs[:, 0], NONE), np.append(pairs[:, 1], NO_RANK)
        self.made = np.zeros(int(pairs[:, 1].max(initial=0)) + 1, np.int64)
        self.made[pairs[:, 1]] = pairs[:, 2]
        self.byte_ids = np.array([self.ids.get(b, 0) for b in self.single], np.int64)
        #: Only tokens that merging can reach may be proposed.
        every = list(self.ids)
        flat, sizes = self.merge_all(every)
        first = flat[np.cumsum(sizes) - sizes].tolist()
        self.reach = {b: self.ids[b] for b, n, i in zip(every, sizes.tolist(), first, strict=True) if n == 1 and i == self.ids[b]}
        #: By its first four bytes, the length of the longest such token.
        self.longest: dict[bytes, int] = {}
        for b in self.reach:
            self.longest[b[:4]] = max(self.longest.get(b[:4], 0), len(b))

    def merge(self, word: bytes) -> list[int]:
        """The exact loop: merge the leftmost pair of lowest rank until none is left."""
        rank, parts = self.ranks.get, [self.single[b] for b in word]
        waiting = [rank(p, NONE) for p in zip(parts, parts[1:], strict=False)]
        while waiting and (least := min(waiting)) != NONE:
            at = waiting.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del waiting[at]
            if at < len(waiting):
                waiting[at] = rank((parts[at], parts[at + 1]), NONE)
            if at:
                waiting[at - 1] = rank((parts[at - 1], parts[at]), NONE)
        return [self.ids[p] for p in parts]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The exact loop over many non-empty words at once: ids of all words in a row, and how many each has.

        Each round merges in every unfinished word the leftmost pair of lowest rank.  Words over
        LONG bytes would need as many rounds, so they run the loop on their own.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        done: dict[int, list[int]] = {int(k): self.merge(words[k]) for k in np.flatnonzero(lengths > LONG)}
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        syms = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short.tolist()]), np.uint8)]
        owner = np.repeat(short, lengths[short])
        out_ids, out_owner = [], []
        ranks = np.full(len(syms), NO_RANK)
        if len(syms) > 1:
            ranks[:-1] = np.where(owner[1:] == owner[:-1], self.rank_of(syms[:-1], syms[1:]), NO_RANK)
        while len(syms):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(ranks << 32 | np.arange(len(syms)), starts)
            live = least >> 32 != NO_RANK
            at = least[live] & 0xFFFFFFFF
            syms[at] = self.made[least[live] >> 32]
            keep = np.repeat(live, np.diff(np.append(starts, len(syms))))
            out_ids.append(syms[~keep])
            out_owner.append(owner[~keep])
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            at = place[at]
            syms, owner, ranks = syms[keep], owner[keep], ranks[keep]
            for left in (at[at > 0] - 1, at):
                right = np.minimum(left + 1, len(syms) - 1)
                joined = (owner[left] == owner[right]) & (left < right)
                ranks[left] = np.where(joined, self.rank_of(syms[left], syms[right]), NO_RANK)
        for k, ids in done.items():
            out_ids.append(np.array(ids, np.int64))
            out_owner.append(np.full(len(ids), k))
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        whose = np.concatenate(out_owner)
        return np.concatenate(out_ids)[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(words))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        reach, longest, at, end, out = self.reach, self.longest, 0, len(word), []
        while at < end:
            for stop in range(min(end, at + longest.get(word[at : at + 4], 3)), at, -1):
                if (found := reach.get(word[at:stop])) is not None:
                    out.append(found)
                    at = stop
                    break
        return out


class Memory:
    """Ids of segments seen before, in arrays.

    A segment of up to 15 bytes is its own key: two 64-bit words, the second with the length and a mark in its top
    byte.  Keys stand in an open-addressed table, so that a batch is looked up in a few array operations.
    Longer segments stand in a dictionary.  Places number the entries of both.
    """

    def __init__(self, slots: int = SLOTS):
        self.bits, size = slots, 1 << slots
        self.low, self.high, self.of = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.room = size // 2
        self.starts, self.counts, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.places = self.stored = self.short = 0
        self.long: dict[bytes, int] = {}

    def slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The places of keys, -1 where unknown."""
        at = self.slot(low, high)
        seen = self.high.take(at)
        out = np.where((seen == high) & (self.low.take(at) == low), self.of.take(at), -1)
        go = np.flatnonzero((out < 0) & (seen != 0))
        at = at.take(go)
        while len(go):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.high.take(at)
            hit = (seen == high.take(go)) & (self.low.take(at) == low.take(go))
            out[go[hit]] = self.of.take(at[hit])
            on = ~hit & (seen != 0)
            go, at = go[on], at[on]
        return out

    def store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Writes runs of ids behind what is kept and returns their places; keep() makes them last."""
        need, n = self.stored + len(ids), self.places + len(sizes)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, need), np.uint32)])
        if n > len(self.starts):
            more = np.zeros(max(len(self.starts) // 2, n), np.int64)
            self.starts, self.counts = np.concatenate([self.starts, more]), np.concatenate([self.counts, more])
        self.ids[self.stored : need] = ids
        self.starts[self.places : n] = self.stored + np.cumsum(sizes) - sizes
        self.counts[self.places : n] = sizes
        return np.arange(self.places, n)

    def keep(self, low: np.ndarray, high: np.ndarray, long: list[bytes], ids: int) -> None:
        """Remembers the runs stored last, those of distinct new keys and then of long segments, if there is room."""
        if self.short + len(low) > self.room or len(self.long) + len(long) > LONG_SEGMENTS or any(len(x) > LONG for x in long):
            return
        place, at = np.arange(self.places, self.places + len(low)), self.slot(low, high)
        self.long.update(zip(long, range(self.places + len(low), self.places + len(low) + len(long)), strict=True))
        self.places, self.stored, self.short = self.places + len(low) + len(long), self.stored + ids, self.short + len(low)
        while len(at):
            free = np.flatnonzero(self.high.take(at) == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.low[at[put]], self.high[at[put]], self.of[at[put]] = low[put], high[put], place[put]
            on = np.ones(len(at), bool)
            on[put] = False
            low, high, place, at = low[on], high[on], place[on], (at[on] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Encodes batches of texts; remembers segments, words and tested pairs."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.memory = Memory()
        self.known_words: dict[bytes, bytes] = {}
        self.special = {s.encode(): i for s, i in self.vocab.special.items()}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.proposed = self.merged = 0

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Tests sorted distinct pairs (a << 32 | b) against the sorted array of known ones; unknown ones are merged once."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        at = np.searchsorted(self.pairs, pairs)
        new = pairs if not len(self.pairs) else pairs[self.pairs[np.minimum(at, len(self.pairs) - 1)] != pairs]
        if len(new):
            left, right, of = new >> 32, new & 0xFFFFFFFF, self.vocab.bytes_of
            flat, sizes = self.vocab.merge_all([of[a] + of[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])
            first = np.cumsum(sizes) - sizes
            good = (sizes == 2) & (flat[first] == left) & (flat[np.minimum(first + 1, len(flat) - 1)] == right)
            every, fits = np.concatenate([self.pairs, new]), np.concatenate([self.fits, good])
            order = np.argsort(every, kind="stable")
            self.pairs, self.fits = every[order], fits[order]
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def words(self, segment: str) -> list[bytes]:
        """The pretokens of a segment. Up to U+02AF the classes are spelled out; beyond, the library cuts."""
        if not BEYOND.search(segment):
            return [p.encode() for p in LATIN.findall(segment)]
        of = self.vocab.chars
        return [bytes(of[c] for c in piece) for piece, _ in self.vocab.pretokens(segment)]

    def learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments not seen before in a row, and how many each has."""
        known, new = self.known_words, {}
        parts = [self.words(s) for s in segments]
        for p in parts:
            for w in p:
                if w not in known:
                    new[w] = None
        words = list(new)
        ids = list(map(self.vocab.propose, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(ids)), sizes)
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            keys, back = np.unique((flat[:-1] << 32 | flat[1:])[same], return_inverse=True)
            failing = np.unique(owner[1:][same][~self.compatible(keys)[back]]).tolist() if len(keys) else []
        else:
            failing = []
        coded = sliced(flat, sizes)
        for k, x in zip(failing, sliced(*self.vocab.merge_all([words[k] for k in failing])), strict=True):
            coded[k] = x
        self.merged += len(failing)
        self.proposed += len(ids)
        fresh = dict(zip(words, coded, strict=True))
        get = lambda w: fresh[w] if w in fresh else known[w]
        out = [b"".join(map(get, p)) for p in parts]
        if len(known) + len(words) <= REMEMBER:
            known.update((w, x) for w, x in fresh.items() if len(w) <= LONG)
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def encode_all(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the edges between texts (one more than texts). Null is empty; bytes that are not UTF-8 are replaced as Python does."""
        texts = [t or b"" for t in texts]
        joined = b"\0".join([*texts, b""])
        try:
            joined.decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
            joined = b"\0".join([*texts, b""])
        if self.split_special and self.split_special.search(joined):
            return self._with_special(texts)
        return self._plain(texts, joined)

    def _with_special(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        pieces, kinds, stops = [], [], [0]
        for t in texts:
            for x in self.split_special.split(t):
                kinds.append(self.special.get(x, -1))
                pieces.append(b"" if kinds[-1] >= 0 else x)
            stops.append(len(pieces))
        flat, edges = self._plain(pieces, b"\0".join([*pieces, b""]))
        kinds = np.array(kinds, np.int64)
        at = np.flatnonzero(kinds >= 0)
        shift = np.concatenate([[0], np.cumsum(kinds >= 0)])
        return np.insert(flat, edges[at], kinds[at]), (edges + shift)[stops]

    def _plain(self, texts: list[bytes], joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """encode_all without special tokens; joined holds the texts, each with a zero byte after it."""
        n = len(joined)
        if not texts or n == len(texts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        raw = np.zeros((n + 31) // 8 * 8, np.uint8)
        raw[:n] = np.frombuffer(joined, np.uint8)
        cuts = np.flatnonzero(raw[:n] == 32)
        cuts = cuts[CUTS.take(raw.take(cuts + 1))] + 1
        opens = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        opens = np.concatenate([[0], opens[:-1]])
        bare = np.searchsorted(cuts, opens) + np.arange(len(opens))
        start = np.insert(cuts, bare - np.arange(len(opens)), opens)
        size = np.diff(np.append(start, n)) - 1
        mark = np.zeros(len(start), np.uint64)
        mark[bare] = 128
        words = raw.view(np.uint64)

        def word(at: np.ndarray) -> np.ndarray:
            k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            return words.take(k) >> shift | words.take(k + 1) << (np.uint64(63) - shift) << np.uint64(1)

        low = word(start) & MASKS.take(np.minimum(size, 8))
        high = word(start + 8) & MASKS.take(np.clip(size - 8, 0, 7)) | (size.astype(np.uint64) | mark) << np.uint64(56)
        place = self.memory.find(low, high)
        long = np.flatnonzero(size > 15)
        names = [joined[a : a + k] for a, k in zip(start[long].tolist(), size[long].tolist(), strict=True)]
        names = [b"\0" + x if m else x for x, m in zip(names, (mark[long] > 0).tolist(), strict=True)]
        place[long] = np.fromiter((self.memory.long.get(x, -1) for x in names), np.int64, len(names))
        miss = np.flatnonzero((place < 0) & (size <= 15))
        order = miss[np.lexsort((low[miss], high[miss]))]
        new = np.ones(len(order), bool)
        new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        first = order[new]
        fresh = dict.fromkeys(x for x, p in zip(names, place[long].tolist(), strict=True) if p < 0)
        pieces = [joined[a : a + k].decode() if m else " " + joined[a : a + k].decode() for a, k, m in zip(start[first].tolist(), size[first].tolist(), mark[first].tolist(), strict=True)]
        pieces += [x[1:].decode() if x[:1] == b"\0" else " " + x.decode() for x in fresh]
        if pieces:
            ids, sizes = self.learn(pieces)
            at = self.memory.store(ids, sizes)
            place[order] = at[np.cumsum(new) - 1]
            if fresh:
                fresh.update(zip(fresh, at[len(first) :].tolist(), strict=True))
                gone = np.flatnonzero(place[long] < 0)
                place[long[gone]] = [fresh[names[k]] for k in gone.tolist()]
            self.memory.keep(low[first], high[first], list(fresh), len(ids))
        count = self.memory.counts.take(place)
        ends = np.cumsum(count)
        index = np.arange(ends[-1]) - np.repeat(ends - count - self.memory.starts.take(place), count)
        return self.memory.ids.take(index), np.append((ends - count)[bare], ends[-1])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as bytes of little-endian unsigned 32-bit integers."""
        flat, edges = self.encode_all(texts)
        raw, edges = flat.astype("<u4").tobytes(), (4 * edges).tolist()
        return [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n, a, d = [], [], []
            flat, edges = enc.encode_all(b.column("text").to_pylist())
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ids = flat[start:stop]
                n.append(len(ids))
                a.append(hashlib.sha256(str(ids.tolist())[1:-1].replace(" ", "").encode()).hexdigest())
                text = enc.decode(ids)
                d.append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return raw_text(docs, "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
