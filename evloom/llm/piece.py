"""SentencePiece encoding with source offsets (operator 12).

Normalisation walks a text by longest prefix through the model's compiled character map and records, for each
byte it writes, where in the source that came from.  The normalised text is cut at word starts: no piece of the vocabulary
holds a space behind another character, so words are encoded on their own and remembered.  New words are merged in arrays, all
of a batch at once; long ones first fall apart wherever no piece holds the two characters side by side.  A piece's
bytes in the normalised text give, through the record, its span of source bytes.

Null and empty texts have the begin and end ids only.  Texts are never cut: memory follows the longest text of a batch.  Bytes
that are not UTF-8 are replaced.  Only BPE models with byte fallback, without user-defined or unused pieces, can be used; others are refused.
Columns other than the text and those to keep are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evloom.llm.bpe import LONG, MASKS, NONE, NO_RANK, Memory
from evloom.llm.common import raw_text

#: Fixed values of the library: the mark that stands for a space, what decoding gives for an unknown piece, and the kinds of pieces.
MARK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
SPACE = 32


class CharacterMap:
    """Longest-prefix replacements: a trie as a double array of 32-bit units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        self._starts: dict[int, bool] = {}

    def __bool__(self) -> bool:
        return bool(self.units)

    def starts(self, byte: int) -> bool:
        """Whether any entry begins with this byte."""
        if byte not in self._starts:
            at = self._child(0, byte)
            self._starts[byte] = at >= 0
        return self._starts[byte]

    def _child(self, node: int, byte: int) -> int:
        unit = self.units[node]
        at = node ^ (unit >> 10 << ((unit & 512) >> 6)) ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest entry that text has at a place, and its length."""
        node, found = 0, None
        for k in range(at, len(text)):
            node = self._child(node, text[k])
            if node < 0:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                leaf = self.units[node ^ (unit >> 10 << ((unit & 512) >> 6))]
                found = leaf & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Normaliser:
    """A text as the model sees it, with 0x20 wherever the library has its mark, and the source place of each byte and of the end."""

    def __init__(self, blob: bytes, prefix: bool, trim: bool):
        self.map, self.prefix, self.trim = CharacterMap(blob), prefix, trim

    def plain(self) -> bool:
        """Whether bytes stay as they are, but for a space put in front."""
        return not self.map and self.prefix and not self.trim

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        mark = MARK.encode()
        out, places, at, end = bytearray(), [], 0, len(text)
        if self.trim:
            while at < end and (step := self._step(text, at))[0] == b" ":
                at += step[1]
        if at == end:
            return b"", np.array([0] if not end else [end])
        if self.prefix:
            out.append(SPACE)
            places.append(at)
        blank = self.trim
        while at < end:
            new, used = self._step(text, at)
            if blank:
                new = new.lstrip(b" ")
            if new:
                blank = self.trim and new.endswith(b" ")
            new = new.replace(mark, b" ")
            out += new
            places += [at] * len(new)
            at += used
        if self.trim:
            keep = len(out.rstrip(b" "))
            at = places[keep] if keep < len(places) else at
            del out[keep:], places[keep:]
        return bytes(out), np.array([*places, at])

    def _step(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What the text from a place on begins with, normalised, and how many source bytes that takes."""
        if self.map and self.map.starts(text[at]) and (found := self.map.longest(text, at)):
            return found
        first = text[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return text[at : at + size], size


class Model:
    """Pieces and merges of a SentencePiece BPE file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = [p.type for p in spec.pieces]
        trainer, norm = spec.trainer_spec, spec.normalizer_spec
        if trainer.model_type != BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not norm.escape_whitespaces or {DEFINED, UNUSED} & set(kinds):
            raise ValueError("only BPE models with byte fallback, escaped spaces and no user-defined or unused pieces can be used")
        self.begin, self.end, self.unknown = kinds.index(CONTROL) if trainer.bos_id < 0 else trainer.bos_id, trainer.eos_id, trainer.unk_id
        self.normaliser = Normaliser(norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces)
        pieces = [p.piece for p in spec.pieces]
        self.of_byte = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.of_byte[int(pieces[i][3:-1], 16)] = i
        #: What a piece adds to a decoded text; of a normal piece also what it takes of the normalised text.
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        normal = {p.replace(MARK, " "): (i, spec.pieces[i].score) for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        if any(" " in p.lstrip(" ") for p in normal):
            raise ValueError("a piece holds a space behind another character: words can't be encoded on their own")
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.longest = max(map(len, normal), default=1)
        #: Characters are numbered by their piece, or past all pieces by code point where they have none.
        self.size = len(pieces)
        scores = sorted({s for _, s in normal.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.rank_by_piece = {p: rank[s] for p, (_, s) in normal.items() if len(p) > 1}
        #: Every way to put a piece together from two, as sorted keys (left << 32 | right), ranks and results.
        rows = []
        for p, (i, s) in normal.items():
            for k in range(1, len(p)):
                left, right = self.symbol(p[:k]), self.symbol(p[k:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, rank[s], i))
        pairs = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = np.append(pairs[:, 0], NONE), np.append(pairs[:, 1], NO_RANK), np.append(pairs[:, 2], 0)
        #: Pairs of characters that stand side by side in a piece: elsewhere nothing merges.
        self.beside = {p[k : k + 2] for p in normal for k in range(len(p) - 1)}
        every = np.array(sorted({ord(c) for p in normal if len(p) == 1 for c in p}), np.int64)
        self.chars, self.char_ids = np.append(every, 1 << 40), np.append(np.array([self.ids[chr(c)] for c in every.tolist()], np.int64), 0)

    def symbol(self, text: str) -> int | None:
        return self.ids[text] if text in self.ids else self.size + ord(text) if len(text) == 1 else None

    def apart(self, word: str) -> list[str]:
        """A word's parts that nothing merges across."""
        cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.beside), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, word: str) -> list[str]:
        """The exact loop for one long word: a heap of pairs by rank and place."""
        rank, n = self.rank_by_piece.get, len(word)
        text, before, after = list(word), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, 2) for k in range(n - 1) if (r := rank(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            other = after[k]
            if not text[k] or other < 0 or len(text[k]) + len(text[other]) != size:
                continue
            text[k] += text[other]
            text[other] = ""
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank(text[a] + text[b])) is not None:
                    heapq.heappush(heap, (r, a, len(text[a]) + len(text[b])))
        return [t for t in text if t]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct non-empty words in a row, and how many each has. Each round merges in every unfinished word the leftmost pair of least rank."""
        parts, owner = [], []
        for k, w in enumerate(words):
            if len(w) <= LONG:
                parts.append(w)
                owner.append(k)
            else:
                for p in self.apart(w):
                    for x in [p] if len(p) <= LONG else self.merge(p):
                        parts.append(x)
                        owner.append(k)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.searchsorted(self.chars, points)
        syms = np.where(self.chars[at] == points, self.char_ids[at], self.size + points)
        part = np.repeat(np.arange(len(parts)), lengths)
        out_ids, out_part = [], []

        def found(left, right):
            keys = left << 32 | right
            at = np.searchsorted(self.keys, keys)
            return np.where(self.keys[at] == keys, at, -1)

        # Of each pair of neighbours, its row in the table of merges.
        rows = np.full(len(syms), -1)
        if len(syms) > 1:
            rows[:-1] = np.where(part[1:] == part[:-1], found(syms[:-1], syms[1:]), -1)
        ranks = np.where(rows >= 0, self.ranks[rows], NO_RANK)
        while len(syms):
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            least = np.minimum.reduceat(ranks << 32 | np.arange(len(syms)), starts)
            live = least >> 32 != NO_RANK
            at = least[live] & 0xFFFFFFFF
            syms[at] = self.made[rows[at]]
            keep = np.repeat(live, np.diff(np.append(starts, len(syms))))
            out_ids.append(syms[~keep])
            out_part.append(part[~keep])
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            syms, part, rows, ranks = syms[keep], part[keep], rows[keep], ranks[keep]
            for left in (at[at > 0] - 1, at):
                right = np.minimum(left + 1, len(syms) - 1)
                joined = (part[left] == part[right]) & (left < right)
                rows[left] = np.where(joined, found(syms[left], syms[right]), -1)
                ranks[left] = np.where(rows[left] >= 0, self.ranks[rows[left]], NO_RANK)
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        whose = np.concatenate(out_part)
        ids = np.concatenate(out_ids)[np.argsort(whose, kind="stable")]
        whose = np.asarray(owner, np.int64)[np.sort(whose)]
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):  # a character without a piece becomes its bytes
            spelled = [chr(c).encode() for c in (ids[odd] - self.size).tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[odd] = list(map(len, spelled))
            ids, whose = np.repeat(ids, sizes), np.repeat(whose, sizes)
            ids[ids >= self.size] = self.of_byte[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(whose, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.normaliser.trim:  # every leading piece loses a space until one is not empty without it
            gone = 0
            for i in ids:
                piece = self.bytes_of[i]
                gone += piece[:1] == b" "
                if piece not in (b"", b" "):
                    break
            raw = raw[gone:]
        elif self.normaliser.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> str:
    """Each byte that isn't part of UTF-8 becomes U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "�"]
            raw = raw[e.start + 1 :]
    return "".join(out)


class PieceEncoder:
    """Encodes batches of texts; remembers words."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.memory = Memory()

    def normalised(self, texts: list[bytes | None]) -> tuple[list[bytes], list[np.ndarray] | None]:
        """Normalised texts, and source places where they aren't those of a text with a space in front."""
        out, mark = [], MARK.encode()
        if self.model.normaliser.plain():
            for t in texts:
                t = t or b""
                try:
                    t.decode()
                    kept = mark not in t
                except UnicodeDecodeError:
                    kept = False
                if not kept:
                    break
                out.append(b" " + t if t else t)
            else:
                return out, None
        pairs = [self.model.normaliser(_replaced(t or b"").encode()) for t in texts]
        return [n for n, _ in pairs], [p for _, p in pairs]

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all normalised texts in a row, without begin and end, and the edges between texts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined, n = b"".join(texts), int(sizes.sum())
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        raw = np.zeros((n + 31) // 8 * 8, np.uint8)
        raw[:n] = np.frombuffer(joined, np.uint8)
        blank = raw[:n] == SPACE
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        opens = np.cumsum(sizes) - sizes
        first[opens[sizes > 0]] = True
        start = np.flatnonzero(first)
        stop = np.append(start[1:], n)
        # The first space is left out of a word's key, and marked where there is none.
        bare = ~blank[start]
        at, size = start + ~bare, stop - start - ~bare
        words = raw.view(np.uint64)

        def word(at: np.ndarray) -> np.ndarray:
            k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            return words.take(k) >> shift | words.take(k + 1) << (np.uint64(63) - shift) << np.uint64(1)

        mark = np.where(bare, np.uint64(128), np.uint64(64))
        low = word(at) & MASKS.take(np.minimum(size, 8))
        high = word(at + 8) & MASKS.take(np.clip(size - 8, 0, 7)) | (size.astype(np.uint64) | mark) << np.uint64(56)
        place = self.memory.find(low, high)
        long = np.flatnonzero(size > 15)
        names = [joined[a:b] for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True)]
        place[long] = np.fromiter((self.memory.long.get(x, -1) for x in names), np.int64, len(names))
        miss = np.flatnonzero((place < 0) & (size <= 15))
        order = miss[np.lexsort((low[miss], high[miss]))]
        new = np.ones(len(order), bool)
        new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        lead = order[new]
        fresh = dict.fromkeys(x for x, p in zip(names, place[long].tolist(), strict=True) if p < 0)
        unseen = [joined[a:b].decode() for a, b in zip(start[lead].tolist(), stop[lead].tolist(), strict=True)] + [x.decode() for x in fresh]
        if unseen:
            ids, counts = self.model.encode_words(unseen)
            at = self.memory.store(ids, counts)
            place[order] = at[np.cumsum(new) - 1]
            if fresh:
                fresh.update(zip(fresh, at[len(lead) :].tolist(), strict=True))
                gone = np.flatnonzero(place[long] < 0)
                place[long[gone]] = [fresh[names[k]] for k in gone.tolist()]
            self.memory.keep(low[lead], high[lead], list(fresh), len(ids))
        count = self.memory.counts.take(place)
        ends = np.cumsum(count)
        index = np.arange(ends[-1]) - np.repeat(ends - count - self.memory.starts.take(place), count)
        edges = np.searchsorted(start, np.append(opens, n))
        return self.memory.ids.take(index), np.append(0, ends)[edges]

    def spans(self, ids: np.ndarray, normal: bytes, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """First source byte of each piece and one past its last. Of the byte pieces of one character, the last has the character and those before are empty, as in the library."""
        model = self.model
        sizes = _piece_sizes(model)[ids]
        stop = np.cumsum(sizes)
        begin = stop - sizes
        if model.is_byte[ids].any():
            char = np.append((np.frombuffer(normal, np.uint8) & 0xC0) != 0x80, True)
            here = model.is_byte[ids]
            first = np.maximum.accumulate(np.where(char[begin], begin, 0))
            begin = np.where(here, first, begin)
            stop = np.where(here & ~char[stop], begin, stop)
        if places is None:
            return np.maximum(begin - 1, 0), np.maximum(stop - 1, 0)
        return places[begin], places[stop]


@lru_cache(maxsize=2)
def _sizes(model: Model) -> np.ndarray:
    return np.fromiter(map(len, model.bytes_of), np.int64, model.size)


def _piece_sizes(model: Model) -> np.ndarray:
    return _sizes(model)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    return PieceEncoder(path)


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """keep columns, ids (with begin and end), starts and stops: the source bytes of each piece, and the decoded text."""

    def run(batches):
        enc = encoder(path)
        model = enc.model
        for b in batches:
            texts = b.column("text").to_pylist()
            normal, places = enc.normalised(texts)
            flat, edges = enc.encode_all(normal)
            ids, starts, stops, decoded = [], [], [], []
            for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                here = flat[a:z]
                begin, stop = enc.spans(here, normal[k], places and places[k])
                end = len(texts[k] or b"")
                ids.append([model.begin, *here.tolist(), model.end])
                starts.append([0, *begin.tolist(), end])
                stops.append([0, *stop.tolist(), end])
                decoded.append(model.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, pa.list_(pa.int64())) for x in (ids, starts, stops)), pa.array(decoded, pa.string())], names=[*keep, "ids", "starts", "stops", "decoded"])

    kinds = dict(docs.dtypes)
    return raw_text(docs, *keep).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "ids array<long>, starts array<long>, stops array<long>, decoded string"]))


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text, and span_bytes: source bytes that the pieces' spans cover."""

    def run(batches):
        enc = encoder(path)
        model = enc.model
        for b in batches:
            normal, places = enc.normalised(b.column("text").to_pylist())
            flat, edges = enc.encode_all(normal)
            n, a, d, covered = [], [], [], []
            for k, (at, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                ids = np.empty(z - at + 2, "<u4")
                ids[0], ids[1:-1], ids[-1] = model.begin, flat[at:z], model.end
                begin, stop = enc.spans(flat[at:z], normal[k], places and places[k])
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(model.decode(ids.tolist()).encode()).hexdigest())
                covered.append(int((stop - begin).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(covered, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])

    return raw_text(docs, "doc_id").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
