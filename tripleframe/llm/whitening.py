"""Whitening of vectors by shifted CholeskyQR.

The distinct vectors, centred, are a tall matrix X = Q R. Each pass over it sums the small Gram matrix of what is left of X, factorises it (the
first time with a small shift, so that rounding cannot make it indefinite), and from then on every task solves its rows against the triangular
factors so far; after three passes Q is orthogonal to double precision and R is the product of the factors. The singular value decomposition of
R, as small as a vector is long, gives the principal components; X itself is never decomposed and never leaves the tasks.

The library has no vectors of its own; the operator takes any ``s`` and ``vector``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.sums import summed
from tripleframe.llm.topk import whole
from tripleframe.plans.support import cut_lineage

PASSES = 3
DEPENDENT = 1e-11  # share of a dimension's variance that must be its own, else it follows from the others
_EPS = float(np.finfo(np.float64).eps)
_TYPES = (np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Whitening:
    """What the passes found: ``components`` in rows (unit vectors by falling variance), ``variances`` of their own and all in ``total``."""
    n: int
    sums: np.ndarray  # whole numbers, exact
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def _packed(rows: DataFrame, scale: float) -> tuple[DataFrame, int, type, int]:
    """Vectors as bytes ``x`` of whole numbers of one length, the length, the type, and the largest absolute number."""
    rows = whole(rows, scale)
    size = F.aggregate("v", F.lit(0).cast("decimal(20,0)"), lambda a, x: F.greatest(a, F.abs(x.cast("decimal(20,0)"))))
    width, top = rows.agg(F.max(F.size("v")), F.max(size)).first()
    width, top = width or 0, int(top or 0)
    kind = next(t for t in _TYPES if t is np.int64 or top <= np.iinfo(t).max)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            out = np.zeros((len(v), width), kind)
            out[np.repeat(np.arange(len(v)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([r.tobytes() for r in out], pa.binary())], names=["s", "x"])

    return rows.select("s", "v").mapInArrow(pack, f"s {rows.schema['s'].dataType.simpleString()}, x binary"), width, kind, top


class _Rows:
    """Whole numbers of a batch and what is made of them; exact whatever their size."""

    def __init__(self, n: int, sums: np.ndarray, width: int, kind: type, top: int):
        self.n, self.sums, self.width, self.kind = n, sums, width, kind
        self.wide = n * max(top, 1) * 2 >= 1 << 62  # n x and S beyond 64 bits
        self.long = width * (2 * n * max(top, 1)) ** 2 >= 1 << 63

    def of(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).reshape(len(column), self.width)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.wide:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x.astype(np.int64) * self.n - self.sums.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        d = self.apart(x)
        return [int(v) for v in ((d.astype(object) if self.long else d) ** 2).sum(1)]


def _exact_sums(fit: DataFrame, width: int, kind: type) -> tuple[int, np.ndarray]:
    """How many vectors there are and the sum of each dimension; numbers go in three parts of 22 bits, so that no sum overflows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(1 + 3 * width, object)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), kind).reshape(len(batch), width).astype(np.int64)
            total[0] += len(x)
            low, mid, high = x & ((1 << 22) - 1), (x >> 22) & ((1 << 22) - 1), x >> 44
            total[1:] += np.concatenate([low.sum(0), mid.sum(0), high.sum(0)]).astype(object)
        return total.astype(np.int64) if total[0] else None

    out = summed(fit, partial, np.int64)
    if out is None:
        return 0, np.zeros(width, object)
    low, mid, high = (out[1 + i * width:1 + (i + 1) * width].astype(object) for i in range(3))
    return int(out[0]), low + mid * (1 << 22) + high * (1 << 44)


def _independent(corr: np.ndarray) -> np.ndarray:
    """Dimensions, rising, none of which follows from the others, by Cholesky with pivots on correlations; constant ones are left out."""
    left, rest, out = corr.copy(), corr.diagonal().copy(), []
    while len(out) < len(rest) and rest.max(initial=0.0) > DEPENDENT:
        j = int(rest.argmax())
        out.append(j)
        col = left[:, j] / np.sqrt(rest[j])
        left = left - np.outer(col, col)
        rest = np.where(np.isin(np.arange(len(rest)), out), 0.0, left.diagonal())
    return np.array(sorted(out), np.int64)


def _backward(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, each by substitution."""
    for r in factors:
        y = y.copy()
        for j in range(len(r)):
            y[:, j] = (y[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def fit_whitening(fit: DataFrame, width: int, kind: type, top: int) -> Whitening | None:
    """Whitening of distinct packed vectors ``x``; None without rows or if all are equal."""
    n, sums = _exact_sums(fit, width, kind)
    if not n or not width:
        return None
    rows = _Rows(n, sums, width, kind, top)

    def gram(left, right) -> np.ndarray:
        """Sum over all rows of left^T right, which are made of centred rows."""
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    z = rows.centred(rows.of(batch.column("x").slice(at, 4096)))
                    a, b = left(z), right(z)
                    total = a.T @ b if total is None else total + a.T @ b
            return None if total is None else total.ravel()
        return summed(fit, partial)

    whole_gram = gram(lambda z: z, lambda z: z).reshape(width, width)
    variance = whole_gram.diagonal() / n
    if not variance.max() > 0:
        return None
    # Dimensions are brought to one scale first; those that follow from others get their part of R from a product with Q.
    scale = np.sqrt(np.where(variance > 0, variance, 1.0))
    own = _independent(whole_gram / n / np.outer(scale, scale))
    other = np.setdiff1d(np.arange(width), own)
    d = len(own)
    unit = lambda z: z[:, own] / scale[own]
    factors: list[np.ndarray] = []
    g = whole_gram[np.ix_(own, own)] / np.outer(scale[own], scale[own])
    for turn in range(PASSES):
        if turn:
            now = list(factors)
            g = gram(lambda z: _backward(unit(z), now), lambda z: _backward(unit(z), now)).reshape(d, d)
        shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * np.linalg.norm(g, 2) if turn == 0 else 0.0
        factors.append(np.linalg.cholesky((g + g.T) / 2 + min(shift, 1e-3 * np.trace(g) / d) * np.eye(d)).T)
    r = np.zeros((d, width))
    product = factors[0]
    for f in factors[1:]:
        product = f @ product
    r[:, own] = product * scale[own]
    if len(other):
        now = list(factors)
        r[:, other] = gram(lambda z: _backward(unit(z), now), lambda z: z[:, other]).reshape(d, len(other))
    _, sigma, components = np.linalg.svd(r, full_matrices=False)
    keep = sigma > sigma[0] * _EPS * max(width, 10)
    sigma, components = sigma[keep], components[keep]
    components = components * np.where(components[np.arange(len(components)), np.abs(components).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, sums, components, sigma ** 2 / n, float(variance.sum()), float("nan"))


def _projected(z: np.ndarray, w: Whitening, most: int) -> np.ndarray:
    return z @ w.components[:most].T / np.sqrt(w.variances[:most])


def whiten(vectors: DataFrame, most: int = 4, scale: float = 256.0) -> DataFrame:
    """``s``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` for every row of ``vectors`` and each of ``most`` components.

    Takes ``s`` and ``vector``; further columns are passed over. Vectors become whole numbers x, ``scale`` times each number, rounded down; vectors
    that are NULL or hold a NULL, NaN or infinite number go, and missing numbers of shorter ones count as zero. The ``n`` distinct x, with sums S, define mean and
    covariance (divisor n). ``whitened`` is x - S / n along the component over the root of its variance, ``explained`` the component's share of all variance,
    ``identity_error`` the largest absolute entry of the covariance of ``whitened`` less the identity, over the distinct x. ``deviation`` is the sum over
    dimensions of (n x - S)^2 as decimal(38,0), exact.

    Repeated rows and rows without ``s`` get their results as well. A component's sign is such that its largest number is positive; components
    of equal variance come in any basis. There are no more components than dimensions in which the vectors differ: equal vectors, a single one, or none
    give no rows. Numbers count as at most 2^63 in size after scaling.
    """
    rows, width, kind, top = _packed(vectors, scale)
    out_kind = rows.schema["s"].dataType.simpleString()
    schema = f"s {out_kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = cut_lineage(rows.select("x").distinct())
    w = fit_whitening(fit, width, kind, top)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    shape = _Rows(w.n, w.sums, width, kind, top)
    m = min(most, len(w.components))

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            p = _projected(shape.centred(shape.of(batch.column("x"))), w, m)
            total = p.T @ p if total is None else total + p.T @ p
        return None if total is None else total.ravel()

    error = float(np.abs(summed(fit, squares).reshape(m, m) / w.n - np.eye(m)).max())
    explained = w.variances[:m] / w.total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = shape.of(part.column("x"))
                p, far = _projected(shape.centred(x), w, m), shape.deviation(x)
                again = np.repeat(np.arange(len(part)), m)
                cols = [part.column("s").take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1), len(part)), pa.int32()), pa.array(np.full(len(again), w.n)),
                        pa.array([Decimal(v) for v in far], pa.decimal128(38, 0)).take(pa.array(again)), pa.array(p.ravel()),
                        pa.array(np.tile(explained, len(part))), pa.array(np.full(len(again), error))]
                yield pa.RecordBatch.from_arrays(cols, names=["s", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
