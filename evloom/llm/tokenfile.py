"""Token-id files coded by an adaptive context-mixing range coder (operator 9).

A block holds the ids of whole documents and is coded on its own: the model starts empty, knows only the ids that the
block's head lists, and two checksums guard it (of the coded bytes, of the ids).  Inside a block the ids are dealt to
lanes, contiguous runs that step through the model together, so that each step is one numpy
operation over all lanes.  A step's distribution is a mixture: order 2 (what followed the two ids before),
order 1 (two followers of the id before) and order 0 (all ids' counts) each give probabilities, and an id's
probability is their sum under weights that adapt, for each class of the contexts' recent success, by the share that each
order had in the ids that came.  The range coder, an asymmetric one whose lanes share one run of words, codes which of the named
followers came, each with its mixed probability, order 0's part included, or that none did; then the id by order 0, in which the named ones keep
their places: taking them out took 18 to 26 % more time and saved 0.03 bits an id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evloom.llm.bpe import Encoder
from evloom.llm.common import raw_text, shared_dir, small_batches

MAGIC = b"EVT4"
#: Ids in a block at least, unless the partition ends; a longer document has a block of its own.
BLOCK_IDS = 1 << 22
STEPS, LANES = 256, 8192
SLOTS = 18
#: Steps after which frequencies and weights are set anew, and between steps whose ids move the weights.
REFRESH, LEARN = 16, 8
#: Segments that the library encodes as one text.
JOINED = 4096
ONE, WORD = np.uint64(1), np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)
#: Order 0's frequencies add up to TOTAL.
SHIFT = 20
TOTAL = 1 << SHIFT
#: Bits of order 1's first follower, trust included.
FIRST = 18
#: What a hit or a miss adds to order 2's follower, by trust + 4 * hit, and to order 1's two, by first trust + 4 * second trust + 16 * first hit + 32 * second hit; trust is 0 to 3.
GAIN2 = np.array([(t < 3) if hit else -(t > 0) for hit in (0, 1) for t in range(4)], np.int32)
GAIN1 = np.array([(ta < 3) if a else (tb < 3) << FIRST if b else -((tb > 0) << FIRST) for b in (0, 1) for a in (0, 1) for tb in range(4) for ta in range(4)], np.int64)
#: The first of the three named followers that came, or 3, by 1, 2 and 4 for those that equal the id.
WHICH = np.array([3, 0, 1, 0, 2, 0, 1, 0], np.int64)
#: Classes of contexts: trust of order 2 and of order 1's two followers, and which of these order 2 names.
KINDS = 256
#: Weights of order 2, order 1's two followers and order 0 before anything is seen.
PRIOR = np.array([2.0, 1.0, 1.0, 12.0])


class Model:
    """Shared by all lanes of a block; coder and decoder feed it the same ids in the same order.

    Followers are held as 4 * id + trust, order 1's two of them in one number, FIRST bits apart.  Sums run in a fixed order, so both sides compute equal numbers.
    """

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.next2, self.next1 = np.zeros(1 << SLOTS, np.int32), np.full(alphabet, 4 * (alphabet - 1) << FIRST, np.int64)
        self.before, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.credit = np.tile(PRIOR[:, None], (1, KINDS))
        self.counts, self.age, self.held, self.every = np.ones(alphabet, np.int64), 0, [], np.arange(lanes)
        self.named, self.marks, self.masses = np.zeros((3, lanes), np.int64), np.zeros((4, lanes), np.int64), np.zeros((4, lanes), np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order 0's frequencies out of TOTAL, at least 1 each, and the weights of each class out of 65536."""
        if self.held:
            self.counts += 24 * np.bincount(np.concatenate(self.held), minlength=self.alphabet)
            self.held = []
            if self.counts.sum() > 1 << 23:
                self.counts = self.counts // 2 + 1
        ends, left = np.cumsum(self.counts), TOTAL - self.alphabet
        self.edges = np.arange(self.alphabet + 1)
        self.edges[1:-1] += (ends[:-1] * (left / ends[-1])).astype(np.int64)
        self.edges[-1] = TOTAL
        self.freq, self.places = np.diff(self.edges), None
        self.spans = np.append(self.edges[:-1] << 32 | self.freq, TOTAL).view(np.uint64)
        if self.credit.max() > 1 << 16:
            self.credit /= 2
        self.weights = (self.credit / self.credit.sum(0) * 65472).astype(np.int64) + 16
        self.weights[3] = 65536 - self.weights[:3].sum(0)

    def predict(self) -> None:
        """Named followers (order 2, order 1, order 1), their mixed masses out of 65536 and, last, that of all other ids."""
        self.slot = (self.before2 * 0x9E3779B1 + self.before * 0x85EBCA6B >> 7) & ((1 << SLOTS) - 1)
        self.f2, self.pair = f2, pair = self.next2.take(self.slot), self.next1.take(self.before)
        named, second = self.named, pair >> FIRST
        np.right_shift(f2, 2, out=named[0])
        np.right_shift(pair & (1 << FIRST) - 1, 2, out=named[1])
        np.right_shift(second, 2, out=named[2])
        self.same1, self.same2 = same1, same2 = named[1] == named[0], named[2] == named[0]
        # Small numbers are held in bytes.
        self.trust2, self.trust1 = f2.astype(np.uint8) & 3, pair.astype(np.uint8) & 3 | (second.astype(np.uint8) & 3) << 2
        self.kind = (self.trust2 << 6 | self.trust1 << 2 | same1.view(np.uint8) << 1 | same2.view(np.uint8)).astype(np.int64)
        self.g = g = self.weights.take(self.kind, axis=1)
        part0 = self.freq.take(named)
        part0 *= g[3]
        part0 >>= SHIFT
        m, marks = self.masses, self.marks
        np.add(g[:3], part0, out=m[:3])
        # What order 2 names as well is named once.
        m[0] += g[1] * same1
        m[0] += g[2] * same2
        m[1] *= ~same1
        m[2] *= ~same2
        marks[1] = m[0]
        np.add(marks[1], m[1], out=marks[2])
        np.add(marks[2], m[2], out=marks[3])
        np.subtract(65536, marks[3], out=m[3])

    def update(self, ids: np.ndarray, which: np.ndarray, mass: np.ndarray) -> None:
        hit2 = which == 0
        if self.age % LEARN == 0 or self.age < REFRESH:
            g = self.g
            share2 = hit2 * g[0] / mass
            sharea = ((which == 1) | hit2 & self.same1) * g[1] / mass
            shareb = ((which == 2) | hit2 & self.same2) * g[2] / mass
            for k, x in enumerate((share2, sharea, shareb, 1 - share2 - sharea - shareb)):
                self.credit[k] += np.bincount(self.kind, x, KINDS)
        # Order 2: one follower that gives way when its trust is gone.
        state = self.trust2 | hit2.view(np.uint8) << 2
        self.next2[self.slot] = self.f2 + GAIN2.take(state) + (state == 0) * ((ids << 2) - self.f2)
        # Order 1: a hit of the second follower makes it the first; a miss takes trust from the second or replaces it.
        pair, state = self.pair, self.trust1 | (self.named[1] == ids).view(np.uint8) << 4 | (self.named[2] == ids).view(np.uint8) << 5
        new = pair + GAIN1.take(state) + (state < 4) * ((ids << 2) - (pair >> FIRST) << FIRST)
        out = np.flatnonzero((state >> 4 == 2) & ((state >> 2 & 3) + 1 >= state & 3))
        first, second = pair[out] & (1 << FIRST) - 1, pair[out] >> FIRST
        new[out] = second & -4 | np.minimum((second & 3) + 1, 3) | first - ((first & 3) > 0) << FIRST
        self.next1[self.before] = new
        self.held.append(ids)
        self.age += 1
        if self.age % REFRESH == 0 or self.age < REFRESH:
            self.refresh()
        self.before2, self.before = self.before, ids

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids that hold places out of TOTAL."""
        if self.places is None:
            self.places = np.repeat(np.arange(self.alphabet, dtype=np.uint16), self.freq)
        return self.places.take(place).astype(np.int64)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """Codes ids below 65536; no ids give a block of no lanes."""
    n = len(ids)
    if not n:
        return MAGIC + struct.pack("<5I", 0, 0, 0, 0, 0)
    if ids.max() > 0xFFFF:
        raise ValueError("ids of up to 16 bits only")
    lanes, steps = _shape(n)
    present = np.zeros(1 << 16, bool)
    present[ids] = True
    alphabet = max(int(present.sum()), 2)
    grid = np.zeros(lanes * steps, np.uint32)
    np.take((np.cumsum(present) - 1).astype(np.uint32), ids, out=grid[:n], mode="clip")
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(alphabet, lanes)
    # Which follower came, as mark << 16 | mass, and the tables of order 0; an id that was named becomes one that takes all of it.
    flags, spans = np.empty((steps, lanes), np.uint32), []
    for k in range(steps):
        model.predict()
        row, (a, b, c) = grid[k].astype(np.int64), model.named
        which = WHICH.take((row == a).view(np.uint8) | (row == b).view(np.uint8) << 1 | (row == c).view(np.uint8) << 2)
        at = which * lanes + model.every
        mass = model.masses.ravel().take(at)
        flags[k] = model.marks.ravel().take(at) << 16 | mass
        grid[k, which < 3] = alphabet
        spans.append(model.spans)
        model.update(row, which, mass)
    x, words = np.full(lanes, ONE << WORD, np.uint64), [np.zeros(0, np.uint32)]

    def put(start: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Lanes that would overflow give their lower half away; all lanes share one run of words."""
        out = np.flatnonzero(x >> np.uint64(64 - bits) >= width)
        full = x[out]
        words.append(full.astype(np.uint32))
        x[out] = full >> WORD
        q = x // width
        np.subtract(x, q * width, out=x)
        np.add(x, start, out=x)
        np.add(x, q << np.uint64(bits), out=x)

    # Backwards, since the decoder takes first what was put last.
    for k in range(steps - 1, -1, -1):
        span = spans.pop().take(grid[k])
        put(span >> WORD, span & LOW32, SHIFT)
        put(flags[k] >> np.uint32(16), (flags[k] & np.uint32(0xFFFF)).astype(np.uint64), 16)
    body = zlib.compress(np.packbits(present).tobytes())
    body = struct.pack("<I", len(body)) + body + x.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()
    return MAGIC + struct.pack("<5I", n, lanes, alphabet, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; a damaged block raises ValueError."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    n, lanes, alphabet, of_ids, of_body = struct.unpack("<5I", block[4:24])
    body = block[24:]
    if not n:
        return np.zeros(0, np.uint32)
    if zlib.crc32(body) != of_body:
        raise ValueError("damaged token block")
    steps, at = -(-n // lanes), 4 + struct.unpack("<I", body[:4])[0]
    ids_of = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(body[4:at]), np.uint8))).astype("<u4")
    x, words, read = np.frombuffer(body, "<u8", lanes, at).astype(np.uint64), np.frombuffer(body, "<u4", offset=at + 8 * lanes), 0
    model, grid = Model(alphabet, lanes), np.empty((steps, lanes), np.uint16)

    def fill(read: int) -> int:
        """Lanes that have become small take the next words."""
        out = np.flatnonzero(x <= LOW32)
        x[out] = x[out] << WORD | words[read : read + len(out)]
        return read + len(out)

    for k in range(steps):
        model.predict()
        marks = model.marks
        place = (x & np.uint64(0xFFFF)).view(np.int64)
        which = ((place >= marks[1]).view(np.uint8) + (place >= marks[2]).view(np.uint8) + (place >= marks[3]).view(np.uint8)).astype(np.int64)
        at = which * lanes + model.every
        mass = model.masses.ravel().take(at)
        place -= marks.ravel().take(at)
        x >>= np.uint64(16)
        x *= mass.view(np.uint64)
        x += place.view(np.uint64)
        read = fill(read)
        row, out = model.named.ravel().take(at, mode="clip"), np.flatnonzero(which == 3)
        y = x[out]
        place = (y & np.uint64(TOTAL - 1)).view(np.int64)
        i = model.find(place)
        x[out] = (y >> np.uint64(SHIFT)) * model.freq.take(i).view(np.uint64) + (place - model.edges.take(i)).view(np.uint64)
        read = fill(read)
        row[out] = i
        grid[k] = row
        model.update(row, which, mass)
    ids = ids_of[grid.T.reshape(-1)[:n]]
    if zlib.crc32(ids.tobytes()) != of_ids:
        raise ValueError("damaged token block")
    return ids


class LibraryEncoder(Encoder):
    """The library itself encodes new segments, many joined to one text.

    Pretokens never cross the space before a segment, so the ids of the joined text are those of its segments in a row,
    and the tokens' byte lengths tell where each ends.  A segment without that space is encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = np.zeros(max(self.vocab.bytes_of) + 1, np.int64)
        for i, b in self.vocab.bytes_of.items():
            self.size[i] = len(b)

    def alone(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def joined(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(segments)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in segments), np.int64, len(segments)))
        reached = np.cumsum(self.size[ids])
        stops = np.searchsorted(reached, ends) + 1
        if reached[-1] != ends[-1] or (reached[stops - 1] != ends).any():
            return self.alone(segments)
        return ids, np.diff(stops, prepend=0)

    def learn(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Those without the space first, each on its own.
        spaced = [k for k, s in enumerate(segments) if s[:1] == " " and s[1:2].isalnum()]
        rest = sorted(set(range(len(segments))).difference(spaced))
        parts = [self.alone([segments[k] for k in rest])] if rest else []
        parts += [self.joined([segments[k] for k in spaced[at : at + JOINED]]) for at in range(0, len(spaced), JOINED)]
        ids, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # Back into the segments' own order.
        back = np.argsort(np.array(rest + spaced), kind="stable")
        start = np.cumsum(sizes) - sizes
        sizes = sizes[back]
        return ids[np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes - start[back], sizes)], sizes


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _kind(doc_id: str) -> str:
    return f"part int, block int, start long, doc_ids array<{doc_id}>, sizes array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, end_id: int, out: str, partitions: int | None = None) -> None:
    """Writes the ids of docs(doc_id of any atomic type, text) in ascending doc_id order (null first, equal ids by text).

    One file for each range of doc_id, one row for each coded block; `start` counts the ids of
    the file before the block.  end_id follows each document; a null text is empty.  An empty table gives files without blocks.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part = library_encoder(path), TaskContext.get().partitionId()
        held, names, sizes, block, start, total = [], [], [], 0, 0, 0

        def row():
            ids = pa.concat_arrays(names)
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([encode_block(np.concatenate(held))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "start", "doc_ids", "sizes", "payload"])

        for b in batches:
            flat, edges = enc.encode_all(b.column("text").to_pylist())
            flat, edges = np.insert(flat, edges[1:], end_id), edges + np.arange(len(edges))
            at = 0
            while at < b.num_rows:
                # Whole documents until the block is full.
                stop = min(int(np.searchsorted(edges, edges[at] + BLOCK_IDS - total)), b.num_rows)
                held.append(flat[edges[at] : edges[stop]])
                names.append(b.column("doc_id").slice(at, stop - at))
                sizes.append(np.diff(edges[at : stop + 1]))
                total += int(edges[stop] - edges[at])
                at = stop
                if total >= BLOCK_IDS:
                    yield row()
                    start, block, total = start + total, block + 1, 0
                    held, names, sizes = [], [], []
        if sizes:
            yield row()

    src = raw_text(docs, "doc_id")
    n = partitions or max(src.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, 1)
    src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _kind(dict(docs.dtypes)["doc_id"])).write.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), ids (bytes of little-endian unsigned 32-bit integers)."""
    blocks = spark.read.parquet(path)
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    # One block is decoded at a time, so a batch holds few of them.
    small_batches(spark)
    ends = blocks.groupBy("part").agg(F.max(F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row for each file: as many as the writer had tasks, whatever the input.
    before = ends.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, sizes = decode_block(b.column("payload")[k].as_py()), np.array(b.column("sizes")[k].as_py(), np.int64)
                stops = np.cumsum(sizes)
                # The ids' bytes as one buffer with offsets; a block of over 2 GB would not fit, nor would its document in a row.
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 4 * stops).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                start = stops - sizes + b.column("start")[k].as_py() + b.column("before")[k].as_py()
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, pa.array(start, pa.int64()), raw], names=["doc_id", "start", "ids"])

    return blocks.join(F.broadcast(before), "part").select("start", "before", "doc_ids", "sizes", "payload").mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def token_file_digest(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes token files to the shared folder, reads them back and digests each document's ids."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, end_id, out)
    back = read_token_files(spark, out)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
