"""Whitening of embeddings by streamed covariance (operator 11).

Each task folds its vectors into (count, mean, scatter) by Welford's rank-one updates; states of tasks merge by the
parallel formula, streamed, in two levels; the eigenvectors of the covariance come from Householder reduction and
implicitly shifted symmetric QR on a matrix of d x d.  Only that matrix, d sums and a count reach the driver.

A vector that is null, or holds a null or a non-finite entry, is dropped.  Vectors of different lengths are spaces of
their own, each with its own fit; an empty vector has no component and gives no row.  A component whose eigenvalue is zero up to rounding
can't be whitened: its `whitened` is null, and it isn't part of the identity's error.  Repeated rows are kept, each distinct
vector counts once in the fit if asked.  No rows give no rows.  Columns other than the vector and those to keep are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.llm.common import discard, materialise, small_batches, stored

#: Sums are text: they may outgrow 64 bits.
STATE = "dim int, bucket int, n long, total array<string>, mean array<double>, scatter array<double>"
#: First-level merges are dealt over so many tasks; the second level merges as many states.
FAN = 32
EPS = float(np.finfo(float).eps)


class Moments:
    """Count, mean and scatter (sum of outer products of deviations) of vectors, and exact sums where they are whole numbers."""

    def __init__(self, d: int):
        self.n, self.total, self.mean, self.scatter = 0, [0] * d, np.zeros(d), np.zeros((d, d))
        self._outer = np.zeros((d, d))

    def add(self, v: np.ndarray) -> None:
        """Welford's update: the scatter grows by the outer product of the deviation with itself, times (n - 1) / n."""
        self.n += 1
        delta = v - self.mean
        np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=self._outer)
        self.scatter += self._outer
        self.mean += delta / self.n

    def merge(self, n: int, total, mean: np.ndarray, scatter: np.ndarray) -> None:
        """The parallel formula."""
        if not n:
            return
        both = self.n + n
        delta = mean - self.mean
        self.scatter += scatter + np.multiply.outer(delta, delta) * (self.n * n / both)
        self.mean += delta * (n / both)
        self.total = [a + int(b) for a, b in zip(self.total, total, strict=True)]
        self.n = both


def _batch(states: dict[int, Moments], bucket: int) -> pa.RecordBatch:
    rows = sorted(states.items())
    cols = [[d for d, _ in rows], [bucket] * len(rows), [m.n for _, m in rows], [list(map(str, m.total)) for _, m in rows], [m.mean for _, m in rows], [m.scatter.ravel() for _, m in rows]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in STATE.split(", ")])


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Each list of a column as an array without copying."""
    flat, stops = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def moments(vectors: DataFrame, whole: bool = False) -> dict[int, Moments]:
    """Moments by vector length of the column v (array<double>, or array<long> if whole: then total is its exact sum)."""
    small_batches(vectors.sparkSession)

    def fold(batches):
        from pyspark import TaskContext

        states: dict[int, Moments] = {}
        for b in batches:
            sums: dict[int, list[np.ndarray]] = {}
            for v in _matrix(b.column("v")):
                state = states.setdefault(len(v), Moments(len(v)))
                if whole:
                    sums.setdefault(len(v), []).append(v)
                state.add(v)
            for d, rows in sums.items():
                # Python numbers take over what 64 bits can't be sure to hold.
                block = np.stack(rows)
                safe = block.dtype.kind == "i" and np.abs(block).max(initial=0) < (1 << 62) // max(1, len(block))
                part = block.sum(axis=0).tolist() if safe else [sum(map(int, c)) for c in block.T]
                states[d].total = [a + x for a, x in zip(states[d].total, part, strict=True)]
        if states:
            yield _batch(states, TaskContext.get().partitionId() % FAN)

    def merged(batches):
        states: dict[int, Moments] = {}
        bucket = 0
        for b in batches:
            bucket = b.column("bucket")[0].as_py() if len(b) else bucket
            for d, n, total, mean, scatter in zip(b.column("dim").to_pylist(), b.column("n").to_pylist(), b.column("total").to_pylist(), _matrix(b.column("mean")), _matrix(b.column("scatter")), strict=True):
                states.setdefault(d, Moments(d)).merge(n, total, mean, scatter.reshape(d, d))
        if states:
            yield _batch(states, bucket)

    found = vectors.where(F.size("v") > 0).select("v").mapInArrow(fold, STATE)
    found = found.repartition(FAN, "bucket").mapInArrow(merged, STATE)
    out: dict[int, Moments] = {}
    for r in found.repartition(1).mapInArrow(merged, STATE).collect():
        out.setdefault(r.dim, Moments(r.dim)).merge(r.n, r.total, np.array(r.mean), np.array(r.scatter).reshape(r.dim, r.dim))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction of a symmetric matrix: diagonal, what stands beside it, and q with a = q t q'."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ x)
        p -= (x @ p) * x
        block -= np.outer(x, p) + np.outer(p, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by QR steps with Wilkinson's shift."""
    d, e, q = tridiagonal(a)
    q = q.T.copy()  # rotations then work on rows
    low = EPS * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0)) * 1e-3
    hi, steps = len(d) - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= EPS * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) * 0.5 + low * EPS
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        cut = np.flatnonzero(e[:hi] == 0)
        lo = int(cut[-1]) + 1 if len(cut) else 0
        steps += 1
        if steps > 60 * len(d):
            raise ArithmeticError("QR steps did not converge")
        half = (d[hi - 1] - d[hi]) / 2
        root = np.hypot(half, e[hi - 1])
        shift = d[hi] - e[hi - 1] * (e[hi - 1] / (half + np.copysign(root, half)))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = q[k].copy()
            q[k] = c * upper + s * q[k + 1]
            q[k + 1] = c * q[k + 1] - s * upper
    order = np.argsort(-d, kind="stable")
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return d[order], q[order].T


@dataclass
class Whitening:
    """Fit of one vector length: components are rows, by falling eigenvalue; scale is null where the eigenvalue is zero."""

    n: int
    total: list[int]
    mean: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        zero = self.values <= len(self.values) * EPS * self.values.max(initial=0) * 8
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(zero, np.nan, 1 / np.sqrt(np.where(zero, 1, self.values)))

    def apply(self, v: np.ndarray, top: int) -> np.ndarray:
        """Rows of vectors as rows of whitened values; NaN where a component can't be whitened."""
        return (v - self.mean) @ self.components[:top].T * self.scale[:top]


def fit(vectors: DataFrame, whole: bool = False) -> dict[int, Whitening]:
    """A whitening for each vector length of the column v. The sign of a component makes its largest entry positive."""
    out = {}
    for d, m in moments(vectors, whole).items():
        cov = m.scatter / m.n
        values, q = symmetric_qr((cov + cov.T) / 2)
        rows = q.T * np.sign(q[np.abs(q).argmax(axis=0), np.arange(d)])[:, None]
        trace = float(np.trace(cov))
        mean = np.array([s / m.n for s in m.total]) if whole else m.mean
        out[d] = Whitening(m.n, m.total, mean, values, rows, np.maximum(values, 0) / trace if trace > 0 else np.zeros(d))
    return out


def identity_error(vectors: DataFrame, fits: dict[int, Whitening], top: int) -> dict[int, float]:
    """By vector length, the largest absolute entry of (covariance of the whitened vectors - identity), from a pass over v."""

    def run(batches):
        for b in batches:
            rows = _matrix(b.column("v"))
            white, dims = [], []
            for d in sorted({len(v) for v in rows}):
                w = fits[d].apply(np.stack([v for v in rows if len(v) == d]), top)
                white += list(w[:, np.isfinite(fits[d].scale[:top])])
                dims += [d] * len(w)
            yield pa.RecordBatch.from_arrays([pa.array(white, pa.list_(pa.float64())), pa.array(dims, pa.int32())], names=["v", "dim"])

    out = dict.fromkeys(fits, 0.0)
    white = vectors.where(F.size("v") > 0).select("v").mapInArrow(run, "v array<double>, dim int")
    for d in fits:
        for k, m in moments(white.where(F.col("dim") == d).select("v")).items():
            out[d] = float(np.abs(m.scatter / m.n - np.eye(k)).max(initial=0))
    return out


def whiten(df: DataFrame, vector: str, *keep: str, top: int = 4, quantum: float | None = None, distinct: bool = True) -> DataFrame:
    """keep columns, component, n, deviation, whitened, explained, identity_error for each row and each of its first components.

    quantum: entries become whole numbers, floor(entry / quantum) (a power of two keeps this exact); deviation is then the exact
    squared distance of n times the vector from the sum (null beyond 64 bits), else null.  distinct: each distinct vector counts once in the fit.
    """
    whole = quantum is not None
    small_batches(df.sparkSession)
    good = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    entry = (lambda c: F.floor(c.cast("double") * F.lit(1 / quantum))) if whole else (lambda c: c.cast("double") + F.lit(0.0))
    rows = df.where(good).select(*keep, F.transform(vector, entry).alias("v"))
    vectors = rows.select("v")
    before = stored()
    vectors = materialise(vectors.distinct() if distinct else vectors, "fit")
    fits = fit(vectors, whole)
    errors = identity_error(vectors, fits, top)
    discard(df.sparkSession, stored() - before)
    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            at, out = [], [[], [], [], [], [], []]
            vs = _matrix(b.column("v"))
            for d in sorted({len(v) for v in vs} - {0}):
                f, here = fits[d], [k for k, v in enumerate(vs) if len(v) == d]
                block = np.stack([vs[k] for k in here])
                m = min(top, d)
                white = f.apply(block, m)
                gap = _deviations(block, f) if whole else [None] * len(here)
                at += np.repeat(here, m).tolist()
                for col, x in zip(out, (np.tile(np.arange(1, m + 1), len(here)).tolist(), [f.n] * (m * len(here)), [g for g in gap for _ in range(m)], [None if np.isnan(x) else x for x in white.ravel().tolist()], np.tile(f.explained[:m], len(here)).tolist(), [errors[d]] * (m * len(here))), strict=True):
                    col += x
            types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "component int, n long, deviation long, whitened double, explained double, identity_error double"])
    return rows.mapInArrow(run, schema)


def _deviations(block: np.ndarray, f: Whitening) -> list[int | None]:
    """Sums over dimensions of (n x - S) ** 2, exact."""
    span = f.n * float(np.abs(block).max(initial=0)) + max(map(abs, f.total))
    if span**2 * block.shape[1] < 2**62:
        gap = f.n * block - np.array(f.total)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((f.n * x - s) ** 2 for x, s in zip(row, f.total, strict=True)) for row in block.tolist()]
    return [x if x < 2**63 else None for x in exact]


def whiten_digest(vectors: DataFrame) -> DataFrame:
    return whiten(vectors, "embedding", "vec_id", quantum=1 / 256)
