"""A quality score for literals: random Fourier features, ridge regression, isotonic calibration.

Each text is summed up in a vector of plain statistics (shares of kinds of characters, repetition, lengths). Random Fourier
features z(x) = sqrt(2/D) cos(Wx + b) make dot products approximate a Gaussian kernel, so ridge regression on z is kernel
regression whose normal equations have a fixed size: every task adds up its own Z'Z and Z'y. Scores of labelled rows kept out of that fit are
then calibrated by pooling adjacent violators, so that a score is a chance of label 1.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.rows import literals as plain
from tripleframe.plans.support import cut_lineage

FEATURES = 512
WIDTH = 1.5
RIDGE = 1e-4
BINS = 2000
_SIGNS = b".,;:!?'\"()[]{}<>|/\\#$%&*+-=@^_~`"


def statistics(text: bytes) -> np.ndarray:
    """Numbers between about 0 and 2 that describe a text; all zero for an empty one."""
    n = len(text)
    if n == 0:
        return np.zeros(20 + len(_SIGNS), np.float32)
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    sizes = np.array([len(w) for w in words] or [0], np.float64)
    count = Counter(words)
    common = sorted(count.values(), reverse=True)[:10] or [0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    share = by / n
    nz = share[share > 0]
    capital = sum(w[:1].isupper() for w in words)
    plain = [np.log1p(len(words)) / 6, np.log1p(n) / 8, min(sizes.mean() / 8, 2), min(sizes.std() / 8, 2),
             min(np.log1p(sizes.max()) / 4, 2), len(count) / nw, common[0] / nw, sum(common) / nw,
             np.sqrt(share[65:91].sum()), np.sqrt(share[97:123].sum()), np.sqrt(share[48:58].sum()),
             np.sqrt(share[128:].sum()), np.sqrt(share[10]) * 3, np.log1p(nl) / 4, np.log1p(n / nl) / 8,
             1 - len(set(lines)) / nl, -(nz * np.log(nz)).sum() / 4, capital / nw,
             len(zlib.compress(text, 1)) / (n + 20), sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / nw]
    return np.array([*plain, *(np.sqrt(share[list(_SIGNS)]) * 3)], np.float32)


def _waves(n: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    return r.normal(0, WIDTH, (n, features)), r.uniform(0, 2 * np.pi, features)


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    cuts: np.ndarray  # raw scores, rising
    levels: np.ndarray  # chance of label 1 at each cut, rising
    seed: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        w, b = _waves(x.shape[1], len(self.weights) - 1, self.seed)
        return _lift(x, w, b)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.cuts):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.lift(x) @ self.weights, self.cuts, self.levels), 0.0, 1.0)


def _lift(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.cos(x.astype(np.float64) @ w + b) * np.sqrt(2 / len(b))
    return np.concatenate([z, np.ones((len(x), 1))], 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("x")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def describe(literals: DataFrame) -> DataFrame:
    """``s`` and ``x``, the statistics of its text, for every row; NULL is an empty text. One pass, no shuffle."""
    kind = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("o").cast(pa.binary()).to_pylist()]
            xs = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays([batch.column("s"), xs], names=["s", "x"])

    lits = plain(literals)
    return lits.mapInArrow(run, f"s {lits.schema['s'].dataType.simpleString()}, x array<float>")


def _pool(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of shares ``ones / n`` at rising ``x``: centres and levels of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, y, m in zip(x, ones, n, strict=True):
        blocks.append([a * m, y, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit_quality(described: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE,
                seed: int = 7) -> QualityModel:
    """Learn from described literals that ``labels`` (``s``, ``quality`` 0 or 1) covers.

    A subject's labels are averaged; NULL subjects and labels are passed over. Three quarters of the labelled
    rows, by a hash of the subject, give the regression, the rest the calibration (all of them, if either would be empty). The sums are of fixed size: ``features`` squared
    in all, one row of which is added up per group, and at most ``BINS`` calibration counts come to the driver. Without labels
    every score is 0.5.
    """
    y = labels.where("s is not null and quality is not null").groupBy(F.col("s").alias("_s")).agg(F.avg("quality").alias("y"))
    rows = described.join(y, F.col("s") == F.col("_s")).select("x", "y", (F.pmod(F.xxhash64(F.col("s").cast("string")), F.lit(4)) == 0).alias("late"))
    rows = cut_lineage(rows)
    n_late, n_early = rows.agg(F.count(F.when(F.col("late"), 1)), F.count(F.when(~F.col("late"), 1))).first()
    if n_late + n_early == 0:
        return QualityModel(np.zeros(features + 1), np.zeros(0), np.zeros(0), seed)
    early, late = (rows.where(~F.col("late")), rows.where("late")) if n_late and n_early else (rows, rows)
    size = features + 1
    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch)
            z = _lift(x, *_waves(x.shape[1], features, seed))
            both = z.T @ np.concatenate([z, batch.column("y").to_numpy()[:, None]], 1)
            total = both if total is None else total + both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), schema.field("v").type)], schema=schema)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"][:1], "v": [np.sum(np.stack(list(rows["v"])), 0)]})

    sums = early.mapInArrow(equations, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").collect()
    full = np.zeros((size, size + 1))
    for r in sums:
        full[r.i] = r.v
    penalty = np.eye(size) * ridge * max(n_early, 1)
    penalty[-1, -1] = 0
    weights = np.linalg.solve(full[:, :size] + penalty + np.eye(size) * 1e-9, full[:, size])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            r = _lift(x, *_waves(x.shape[1], features, seed)) @ weights
            bins = np.clip(np.round((r + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("y")], names=["bin", "y"])

    bins = sorted(late.mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    b, ones, n = (np.array(v, float) for v in zip(*bins, strict=True))
    cuts, levels = _pool(b / BINS * 2 - 0.5, ones, n)
    return QualityModel(weights, cuts, levels, seed)


def score_quality(described: DataFrame, model: QualityModel) -> DataFrame:
    """``s`` and ``score`` (0 to 1) for every described row; equal texts get equal scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(model.score(_matrix(batch)))], names=["s", "score"])
    return described.mapInArrow(run, f"s {described.schema['s'].dataType.simpleString()}, score double")
