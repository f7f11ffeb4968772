"""Word-first language identification with backoff to character n-grams (operator 4).

A known word is scored by its log frequency in each language (a fixed penalty where a language lacks it).  An unseen word
falls back to the longest character n-grams of it that any language knows, from NGRAM letters down to one.
A text's score is the mean over its words; the least wins.

The model is fitted on about PER_LANGUAGE labelled documents of each language, chosen by a hash of the id: that is its
only bound; it holds every word and n-gram of them.  Words and n-grams are counted by Spark, and the model is two kinds of
dictionary over arrays of one number for each language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import crc_mod, materialise, raw_text, small_batches

PER_LANGUAGE = 500
NGRAM = 5
PENALTY = 7.0
#: How fast certainty grows with the distance of the mean scores.
SHARP = 3.0
#: White-space-separated strings whose scores a task remembers, of up to LONGEST characters each.
REMEMBER, LONGEST = 150_000, 40
RUN = re.compile(r"[^\W\d_]+")


def letters(token: str) -> list[str]:
    """Runs of letters in a lower-cased string."""
    if token.isalpha():
        return [token]
    return [w for w in RUN.findall(token) if any(c.isalpha() for c in w)]


def _table(langs: list[str], counts: list[tuple[str, str, int]]) -> tuple[dict[str, int], np.ndarray]:
    """A string's row, and rows of -log10 of its relative frequency in each language, or the penalty, from (language, string, count)."""
    at, lang = {}, {k: i for i, k in enumerate(langs)}
    rows = np.fromiter((at.setdefault(x, len(at)) for _, x, _ in counts), np.int64, len(counts))
    n = np.zeros((len(at), len(langs)))
    np.add.at(n, (rows, np.fromiter((lang[k] for k, _, _ in counts), np.int64, len(counts))), np.fromiter((c for _, _, c in counts), float, len(counts)))
    return at, np.where(n > 0, -np.log10(np.maximum(n, 1) / np.maximum(n.sum(0), 1)), PENALTY).astype(np.float32)


class Model:
    """What is known of words and of n-grams by length. counts: (language, word, how often); grams: the same of n-grams, a space marking a word's ends."""

    def __init__(self, langs: list[str], counts: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = langs
        self.words, self.word_rows = _table(langs, counts)
        by: dict[int, list] = defaultdict(list)
        for x in grams:
            if x[1] != " ":
                by[len(x[1])].append(x)
        self.grams = [_table(langs, by[k]) for k in range(NGRAM + 1)]

    def word(self, word: str) -> np.ndarray:
        if (found := self.words.get(word)) is not None:
            return self.word_rows[found]
        padded = f" {word} "
        for k in range(min(NGRAM, len(padded)), 0, -1):
            at, table = self.grams[k]
            rows = [p for i in range(len(padded) - k + 1) if (p := at.get(padded[i : i + k])) is not None]
            if rows:
                return np.add.reduce(table[rows].astype(float)) / len(rows)
        return np.full(len(self.langs), PENALTY, np.float32)

    def token(self, token: str) -> np.ndarray:
        """Sum over the words in a string, and as the last number how many there are."""
        out = np.zeros(len(self.langs) + 1)
        for w in letters(token):
            out[:-1] += self.word(w)
            out[-1] += 1
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((1024, len(model.langs) + 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure; 'und' and 0 for a text without letters, or with nothing learned."""
        tokens = (text or "").lower().split()
        if not tokens or not self.model.langs:
            return "und", 0.0
        at, extra = self.at, np.zeros(len(self.model.langs) + 1)
        places = list(map(at.get, tokens))
        if None in places:
            for k, t in enumerate(tokens):
                if places[k] is None:
                    if (p := at.get(t)) is None:
                        row = self.model.token(t)
                        if len(at) >= REMEMBER or len(t) > LONGEST:
                            extra += row
                            places[k] = 0
                            continue
                        at[t] = p = len(at) + 1
                        if p >= len(self.rows):
                            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                        self.rows[p] = row
                    places[k] = p
        sums = np.add.reduce(self.rows[places]) + extra
        if not sums[-1]:
            return "und", 0.0
        mean = sums[:-1] / sums[-1]
        best = int(np.argmin(mean.round(9)))
        return self.model.langs[best], float(1 / np.power(10.0, -(mean - mean[best]) * SHARP).sum())


def fit(labelled: DataFrame) -> Model:
    """Learns from labelled(doc_id, text, lang); rows without lang or text are left out. Without any, nothing is learned."""
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(sizes)
    if not langs:
        return Model([], [], [])
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, PER_LANGUAGE / sizes[k]))]), F.col("lang"))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20)

    def run(batches):
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for token in t.decode("utf-8", "replace").lower().split():
                    seen[lang].update(letters(token))
            rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    counts = raw_text(labelled.where(chosen), "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lang-words")
    padded = counts.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("p"))
    cut = f"flatten(transform(sequence(1, least({NGRAM}, length(p))), k -> transform(sequence(1, length(p) - k + 1), i -> substring(p, i, k))))"
    grams = padded.select("lang", "n", F.explode(F.expr(cut)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = lambda df: [tuple(r) for r in df.collect()]  # noqa: E731  # what PER_LANGUAGE documents of each language hold
    return Model(langs, rows(counts.orderBy("lang", "word")), rows(grams.orderBy("lang", "gram")))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, lang_pred, score for each row of docs, from whole texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(None if t is None else t.decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return raw_text(docs, *keep).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string", "score double"]))


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents whose crc32(doc_id as text) modulo folds is not fold."""
    held = crc_mod("doc_id", folds) == fold
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, "doc_id", "held_out")


def language_filter(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """docs whose language can be told, with lang set to the prediction. Other columns stay as they are, and only texts go to Python.

    Repeated rows and null ids are judged like others; an empty table gives no rows.
    """
    model = fit(docs.where(crc_mod("doc_id", folds) != fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer.predict(None if t is None else t.decode("utf-8", "replace"))[0] for t in texts.to_pylist()], pa.string())

    # Not deterministic in name only: so the filter reads the column instead of calling the function again.
    found = docs.withColumn("lang", told.asNondeterministic()(F.col("text").cast("binary")))
    return found.where("lang != 'und'").select(*docs.columns)
