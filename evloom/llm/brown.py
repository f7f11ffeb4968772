"""Class-based bigram language model with classes from exchange clustering (operator 10).

1. Word counts of all training documents: counted within each task, summed by word.
2. The HEAD most frequent words are symbols of their own; all others fall into OPEN groups by
   their last letters.  Counts of neighbouring symbols are gathered from all training documents
   (at most (HEAD + OPEN + 1)^2 numbers, 10 MB), and exchange clustering on the driver moves each symbol to the class that raises the
   training likelihood of the class bigrams most, until no move helps or ROUNDS is reached.
3. One more exchange, distributed: for each of the KNOWN most frequent words the classes beside it are
   counted over all training documents, and the word goes to the class that makes them most likely.  Rarer words have their group's class.
4. The class bigrams are counted again with the final classes, and so are the words of each class, exactly.
5. P(word | before) = P(class | class before) * P(word | class), both smoothed by add-half, so that for each word before
   the probabilities of all known words, the end and one unknown word a class sum to 1.
   Whole texts are scored: counts and classes of the KNOWN words travel with the tasks
   (a bounded table), all rarer words are joined to the counts by word.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import crc_mod, materialise, raw_text

HEAD, OPEN, CLASSES, ROUNDS, KNOWN = 1000, 97, 40, 6, 100_000
#: Occurrences that a word needs to be moved by itself; below, its group says more than its neighbours.
MOVED = 3
#: Words that a task counts before it hands them on.
FLUSH = 300_000


def tokens(text: bytes | None) -> list[bytes]:
    """ASCII lower case, cut at ASCII white space; a null text has none."""
    return (text or b"").lower().split()


def open_group(word: bytes) -> int:
    """The group of a word outside the head, by its last two letters."""
    tail = word.rstrip(b".,;:!?\"')*#$%&")[-2:]
    return (tail[-1] * 31 + (tail[0] if len(tail) > 1 else 0)) % OPEN if tail else 0


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), n over all rows of train(text); the end token is not among them."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(tokens(t))
                if len(seen) >= FLUSH:
                    yield from out()
                    seen.clear()
        if seen:
            yield from out()

    return raw_text(train).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, head) -> DataFrame:
    """pair (left * symbols + right), n: neighbouring symbols, with the end before each first and after each last word."""
    size = HEAD + OPEN + 1
    end = size - 1

    def run(batches):
        ids = {w: i for i, w in enumerate(head.value)}
        total = np.zeros(size * size, np.int64)
        for b in batches:
            flow = [np.array([end])]
            for t in b.column("text").to_pylist():
                words = tokens(t)
                at = list(map(ids.get, words))
                if None in at:
                    at = [HEAD + open_group(w) if k is None else k for k, w in zip(at, words, strict=True)]
                flow.append(np.array(at + [end]))
            flat = np.concatenate(flow)
            total += np.bincount(flat[:-1] * size + flat[1:], minlength=size * size)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    return raw_text(train).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol; the last symbol, the end, keeps a class of its own (the last).

    Raises sum C log C of class pairs minus the sums of class marginals.  Ties go to the lower class; reruns agree.
    """
    size = len(pairs)
    load = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-load[:-1], kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size - 1) % (classes - 1)
    of[-1] = classes - 1
    member = np.eye(classes)[of]
    right, left = pairs @ member, pairs.T @ member
    both = member.T @ right
    x = lambda a: a * np.log(np.maximum(a, 1))
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not load[w]:
                continue
            old, self_n = of[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[old] -= self_n
            c[old] -= self_n
            both[old] -= r
            both[:, old] -= c
            both[old, old] -= self_n
            rows, cols = both.sum(1), both.sum(0)
            gain = (x(both + r) - x(both)).sum(1) + (x(both + c[:, None]) - x(both)).sum(0)
            own = np.diag(both)
            gain += x(own + r + c + self_n) - x(own + r) - x(own + c) + x(own)
            a, b = r.sum() + self_n, c.sum() + self_n
            gain -= x(rows + a) - x(rows) + x(cols + b) - x(cols)
            gain[classes - 1] = -np.inf
            new = int(np.argmax(gain.round(6)))
            both[new] += r
            both[:, new] += c
            both[new, new] += self_n
            if new != old:
                of[w], moved = new, moved + 1
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return of


def _classes(text: bytes | None, known: dict[bytes, int], kind: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in known (-1 for rarer words) and classes of a text's words."""
    words = tokens(text)
    at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    classes = kind[at]
    out = np.flatnonzero(at < 0)
    if len(out):
        classes[out] = group[[open_group(words[k]) for k in out.tolist()]]
    return at, classes


def moved(train: DataFrame, top, kind: np.ndarray, group: np.ndarray, flow: np.ndarray) -> dict[int, int]:
    """New classes of known words (by place, from HEAD on): those that make the training text round the word most likely.

    A word in class c gives for each occurrence P(c | class before) * P(class after | c) / (tokens of c), from flow, the counts of
    class pairs.  Words are held against the classes of their neighbours as they stand, all at once.
    """
    step, size = ClassModel.log_steps(flow), np.log10(flow.sum(0) + 0.5)
    shared = train.sparkSession.sparkContext.broadcast((top, kind, group))

    def run(batches):
        top, kind, group = shared.value
        known = {w: i for i, w in enumerate(top)}
        total = np.zeros(len(top) * 2 * CLASSES, np.int32)
        end = np.array([CLASSES - 1])
        for b in batches:
            for t in b.column("text").to_pylist():
                at, classes = _classes(t, known, kind, group)
                own = np.flatnonzero(at >= HEAD)
                line = np.concatenate([end, classes, end])
                place = at[own] * (2 * CLASSES)
                np.add.at(total, np.concatenate([place + line[own], place + CLASSES + line[own + 2]]), 1)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // (2 * CLASSES), pa.int32()), pa.array(part % (2 * CLASSES), pa.int32()), pa.array(total[part], pa.int64())], names=["word", "beside", "n"])

    counts = raw_text(train).mapInArrow(run, "word int, beside int, n long").groupBy("word", "beside").agg(F.sum("n").alias("n"))
    # At most 2 * CLASSES rows a word.
    lists = counts.groupBy("word").agg(F.collect_list(F.struct("beside", "n")).alias("l")).where(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= 2 * MOVED)

    def best(batches):
        for b in batches:
            new = []
            for row in b.column("l").to_pylist():
                n = np.zeros(2 * CLASSES)
                for x in row:
                    n[x["beside"]] += x["n"]
                fit = n[:CLASSES] @ step + step @ n[CLASSES:] - n[:CLASSES].sum() * size
                fit[CLASSES - 1] = -np.inf
                new.append(int(np.argmax(fit.round(6))))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(new, pa.int32())], names=["word", "class"])

    return {r["word"]: r["class"] for r in lists.mapInArrow(best, "word int, class int").collect()}  # KNOWN rows at most


def class_flow(train: DataFrame, top, kind: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How often a class follows another, the end before each first and after each last word."""
    shared = train.sparkSession.sparkContext.broadcast((top, kind, group))

    def run(batches):
        top, kind, group = shared.value
        known = {w: i for i, w in enumerate(top)}
        flow = np.zeros(CLASSES * CLASSES, np.int64)
        end = np.array([CLASSES - 1])
        for b in batches:
            for t in b.column("text").to_pylist():
                line = np.concatenate([end, _classes(t, known, kind, group)[1], end])
                flow += np.bincount(line[:-1] * CLASSES + line[1:], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flow)), pa.int32()), pa.array(flow, pa.int64())], names=["pair", "n"])

    out = np.zeros(CLASSES * CLASSES)
    for pair, n in raw_text(train).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # CLASSES^2 rows
        out[pair] = n
    return out.reshape(CLASSES, CLASSES)


def group_types(rare: DataFrame) -> np.ndarray:
    """Distinct words of rare(word) in each open group."""

    def run(batches):
        n = np.zeros(OPEN, np.int64)
        for b in batches:
            n += np.bincount([open_group(w) for w in b.column("word").to_pylist()], minlength=OPEN)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(OPEN), pa.int32()), pa.array(n, pa.int64())], names=["g", "n"])

    out = np.zeros(OPEN)
    for g, n in rare.mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():  # OPEN rows
        out[g] = n
    return out


class ClassModel:
    """top: known words with counts; kind, group: classes of known words and of open groups; step, under: log10 of transitions and of the emissions' denominators."""

    def __init__(self, train: DataFrame):
        spark = train.sparkSession
        self.counts = materialise(word_counts(train), "words")
        self.n_docs = train.count()
        total, types = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.total, self.types = total + self.n_docs, types + bool(self.n_docs)
        ranked = self.counts.orderBy(F.desc("n"), "word").limit(KNOWN)
        self.top = [(bytes(w), n) for w, n in ranked.collect()]  # KNOWN rows at most
        self.floor = self.top[-1][1] if len(self.top) == KNOWN else 0
        words = [w for w, _ in self.top]
        size = HEAD + OPEN + 1
        pairs = np.zeros(size * size)
        for pair, n in pair_counts(train, spark.sparkContext.broadcast(words[:HEAD])).toLocalIterator():  # size^2 rows at most
            pairs[pair] = n
        pairs = pairs.reshape(size, size)
        of = exchange(pairs)
        self.group = of[HEAD : HEAD + OPEN]
        # One place more than there are words, so that the place -1 exists.
        self.kind = np.array([of[i] if i < HEAD else of[HEAD + open_group(w)] for i, w in enumerate(words)] + [0], np.int64)
        member = np.eye(CLASSES)[of]
        first = member.T @ pairs @ member
        if len(words) > HEAD:
            for k, c in moved(train, words, self.kind, self.group, first).items():
                self.kind[k] = c
            first = class_flow(train, words, self.kind, self.group)
        self.step = self.log_steps(first)
        known = self.kind[:-1]
        class_n = first.sum(0)
        class_v = np.bincount(known, minlength=CLASSES).astype(float)
        if self.floor:
            rare = self.counts.join(F.broadcast(ranked.select("word")), "word", "left_anti")
            class_v += np.bincount(self.group, weights=group_types(rare.select("word")), minlength=CLASSES)
        class_v[CLASSES - 1] = bool(self.n_docs)
        self.under = np.log10(class_n + 0.5 * (class_v + 1))

    @staticmethod
    def log_steps(flow: np.ndarray) -> np.ndarray:
        return np.log10((flow + 0.5) / (flow.sum(1, keepdims=True) + 0.5 * CLASSES))


def score(docs: DataFrame, train: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Null texts are empty: one token, the end.  With no training rows all counts are zero, and
    V too; repeated rows and null ids are scored like others.
    """
    spark = docs.sparkSession
    m = ClassModel(train)
    counts, total, types, floor = m.counts, m.total, m.types, m.floor
    base_under = math.log10(total + 0.5 * (types + 1))
    model = spark.sparkContext.broadcast((m.top, m.kind, m.group, m.step, m.under, m.n_docs))

    def run(batches):
        top, kind, group, step, under, n_docs = model.value
        known = {w: i for i, (w, _) in enumerate(top)}
        n = np.array([c for _, c in top] + [n_docs, 0], np.float64)
        log_n = np.log10(n + 0.5)
        kind = np.append(kind[:-1], [CLASSES - 1, 0])
        end, miss = len(top), len(top) + 1
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column("text").to_pylist():
                words = tokens(t)
                at = np.array([known.get(w, miss) for w in words] + [end])
                classes = kind[at]
                out = np.flatnonzero(at == miss)
                rare: Counter = Counter()
                for k in out.tolist():
                    classes[k] = group[open_group(words[k])]
                    rare[words[k]] += 1
                seen = at != miss
                before = np.concatenate([[CLASSES - 1], classes[:-1]])
                base = float(log_n[at[seen]].sum())
                mine = float(step[before, classes].sum() - under[classes].sum()) + base
                for col, x in zip(cols, (len(at), int((n[at[seen]] > 0).sum()), base, mine, list(rare), list(rare.values()), len(out)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.binary())), pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.int64())],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "mine", "rare", "times", "missing"],
            )

    marked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"), "text")
    kinds = "row long, doc_id " + dict(docs.dtypes)["doc_id"] + ", held_out boolean, n_tokens long, n_known long, base double, mine double, rare array<binary>, times array<bigint>, missing long"
    scored = materialise(raw_text(marked, "row", "doc_id", "held_out").mapInArrow(run, kinds), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # A rare word is in the table of counts, or its count is zero.
    found = rare.join(counts.where(F.col("n") <= floor) if floor else counts.limit(0), "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("hits"))
    logs, hits = F.coalesce("logs", F.lit(0.0)), F.coalesce("hits", F.lit(0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + hits).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(base_under)).alias("base_score"),
        (F.col("mine") + logs).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """Scores all docs by a model of those whose crc32(doc_id as text) modulo folds is not fold."""
    held = crc_mod("doc_id", folds) == fold
    return score(docs, docs.where(~held), held)
