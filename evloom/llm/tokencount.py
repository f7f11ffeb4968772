"""Token counts of sections from one encoding of the whole document (operator 5).

A document is encoded once.  Its tokens' character spans, sorted by nature, are joined to the
sections' spans by interval search; a token inside one section counts there.  A token
that crosses a boundary is allocated by a rule: `majority` (default: the section with most of its
characters, the earlier one if equal), `start` (the section of its first character) or `share`
(each section gets its part of the characters, so counts may be fractions).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.bpe import encoder
from evloom.llm.common import small_batches

RULES = ("majority", "start", "share")


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    of = encoder(path).vocab.bytes_of
    out = np.zeros(max(of) + 1, np.int64)
    for i, b in of.items():
        out[i] = len(b)
    return out


def token_spans(ids: np.ndarray, sizes: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token touches; tokens that share a character both touch it."""
    ends = np.cumsum(sizes[ids])
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return char[ends - sizes[ids]], char[ends - 1] + 1


def attribute(first: np.ndarray, stop: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of those the ones that cross one of its edges. edges: n + 1 rising character places."""
    n = len(edges) - 1
    a, b = np.searchsorted(edges, first, "right") - 1, np.searchsorted(edges, stop - 1, "right") - 1
    a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
    inside = a == b
    count, crossing = np.bincount(a[inside], minlength=n).astype(float), np.zeros(n)
    for k in np.flatnonzero(~inside):
        span = np.arange(a[k], b[k] + 1)
        part = np.minimum(edges[span + 1], stop[k]) - np.maximum(edges[span], first[k])
        if rule == "share":
            count[span] += part / part.sum()
            crossing[span[part > 0]] += 1
        else:
            to = span[np.argmax(part)] if rule == "majority" else a[k]
            count[to] += 1
            crossing[to] += 1
    return count, crossing


def count_tokens(docs: DataFrame, path: str, parts, rule: str = "majority", *keep: str) -> DataFrame:
    """keep columns, section, n_chars, n_tokens (double), n_crossing for each section of each row.

    parts: a column of type array<string>; joined, its strings are the document, encoded as a whole.  Null strings count
    as empty.  A row whose array is null or empty gives no rows; an empty section gives one with no tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)

    def run(batches):
        enc, sizes = encoder(path), _token_bytes(path)
        for b in batches:
            rows = [[p or "" for p in x or []] for x in b.column("_parts").to_pylist()]
            at, out = [], [[], [], [], []]
            for k, (x, ids) in enumerate(zip(rows, enc.encode(["".join(x).encode() for x in rows]), strict=True)):
                if not x:
                    continue
                edges = np.concatenate([[0], np.cumsum([len(p) for p in x])])
                if len(ids):
                    first, stop = token_spans(np.frombuffer(ids, "<u4"), sizes, "".join(x).encode())
                    count, crossing = attribute(first, stop, edges, rule)
                else:
                    count = crossing = np.zeros(len(x))
                at += [k] * len(x)
                for col, v in zip(out, (range(len(x)), np.diff(edges), count, crossing), strict=True):
                    col.append(np.asarray(v))
            flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
            cols = [pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(float)), pa.array(flat[3].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), *cols], names=[*keep, "section", "n_chars", "n_tokens", "n_crossing"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "section long, n_chars long, n_tokens double, n_crossing long"])
    return docs.select(*keep, parts.alias("_parts")).mapInArrow(run, schema)


def line_sections(docs: DataFrame, path: str, rule: str = "majority") -> DataFrame:
    """Sections are a text's lines, each with the line feed that ends it; a null text has none."""
    lines = F.split("text", r"(?<=\n)(?!\z)")
    return count_tokens(docs, path, F.when(F.col("text").isNotNull(), lines), rule, "doc_id")
