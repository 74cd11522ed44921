"""Groups of literals whose sets of word shingles are nearly the same, found with SetSketch registers.

Each element of a set has one exponential value per register; a register keeps the smallest, on an exponential scale of base b,
cut to 16 bits. Registers of a union are the larger of both, so they can be merged, and equal registers are the likelier the more
similar two sets are. Registers are banded: sets that agree in a whole band meet in a bucket.

* Equal sets are one class from the start; one of it stands for all.
* In every bucket all others are first compared with one member only; how buckets are settled, without all pairs, is in ``near_groups``.
* A comparison first estimates the Jaccard similarity from both registers by maximum likelihood, drops pairs far below the
  threshold, and then counts both whole sets.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import words as W
from tripleframe.llm.near_groups import PIECE_BYTES, confirmed, groups, in_blocks, shingle_sets
from tripleframe.llm.rows import keyed, texts
from tripleframe.llm.rows import literals as as_literals
from tripleframe.plans.support import cut_lineage

BANDS, ROWS = 48, 6  # two sets of similarity 0.8 share no band with a chance of 5e-7
BASE, RATE, TOP = 1.02, 20.0, 65_535
MARGIN = 0.118  # five deviations of the estimate
BLOCK = 1024  # members of a bucket that are compared with as many others at once
SET_BYTES = 16 << 20  # of the whole sets of a block, about
WHOLE = 1 << 20  # shingles of a set that is compared in one piece; larger ones are counted by fragments
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers for each set that is not empty."""
    begin = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begin), len(_SEEDS)), np.uint16)
    for i, seed in enumerate(_SEEDS):
        least = np.minimum.reduceat(h * seed, begin) if len(begin) else np.zeros(0, np.uint64)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP)
    return out


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum-likelihood Jaccard estimates of pairs of register rows whose set sizes are known."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = (na / (na + nb)).astype(np.float64)
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)[:, None]
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
    plus, minus = p(u[:, None] - (1 - u)[:, None] * j), p((1 - u)[:, None] - u[:, None] * j)
    fit = more[:, None] * np.log(plus) + less[:, None] * np.log(minus) + (a.shape[1] - more - less)[:, None] * np.log(np.clip(1 - plus - minus, 1e-9, 1))
    return j[np.arange(len(j)), fit.argmax(1)]


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches, PIECE_BYTES):
            h, first = shingle_sets(os, width)
            n = np.diff(first)
            sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
            for s, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99), strict=True):
                if len(h):
                    s[n > 0] = np.add.reduceat(W.mix(h ^ np.uint64(salt)), first[:-1][n > 0])
            rows = iter(registers(h, first))
            sketch = [next(rows).tobytes() if c else None for c in n]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                                              pa.array(sketch, pa.binary())], names=["k", "n", "sig1", "sig2", "sketch"])
    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _buckets(r: np.ndarray) -> np.ndarray:
    """The bucket of every band of rows of registers."""
    r = r.reshape(len(r), BANDS, ROWS).astype(np.uint64)
    bh = np.zeros(r.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        bh = W.mix((bh ^ r[:, :, i]) * np.uint64(0xD6E8FEB86659FD93))
    return bh.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            bh = _buckets(_registers(batch.column("sketch")))
            ks = np.repeat(batch.column("k").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(bh.ravel())], names=["k", "bh"])


def _estimated(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                e = similarity(_registers(batch.column("sa")), _registers(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                keep = pa.array(e >= floor)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


def _bodies(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches, PIECE_BYTES):
            h, first = shingle_sets(os, width)
            body = [h[a:b].tobytes() if b - a <= WHOLE else None for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(body, pa.binary())], names=["k", "body"])
    return run


def _links(percent: int):
    """Links on whole sets between the members of two blocks of a bucket; of those that connect the same labels only the first.

    A pair is held together in the first of the bands that it shares. Sizes and equal registers come before whole sets: sets of similarity j have at least that
    share of their registers equal on average, so the bound is that of :func:`_estimated`. Pairs with a set that was not sent are not ``sure``.
    """
    def run(rows: pa.Table) -> pa.Table:
        k, c, n, left = (rows.column(x).to_numpy() for x in ("k", "c", "n", "left"))
        r, body = _registers(rows.column("sketch")), rows.column("body").to_pylist()
        buckets, low = _buckets(r), r.astype(np.uint8)
        band = int(np.flatnonzero(buckets[0] == rows.column("bh")[0].as_py())[0])
        sets = [None if x is None else np.frombuffer(x, np.uint64) for x in body]
        whole = np.array([x is not None for x in body])
        one = bool(rows.column("i")[0].as_py() == rows.column("j")[0].as_py())
        side = np.arange(len(k)) if one else np.flatnonzero(~left.astype(bool))
        label = np.unique(c, return_inverse=True)[1].ravel()
        least = (percent / 100 - MARGIN) * r.shape[1]
        out: list[tuple[int, int, bool]] = []
        for x in range(len(k)) if one else np.flatnonzero(left.astype(bool)).tolist():
            at = side[x + 1:] if one else side
            at = at[(label[at] != label[x]) & (100 * np.minimum(n[at], n[x]) >= percent * np.maximum(n[at], n[x]))]
            at = at[np.count_nonzero(low[at] == low[x], axis=1) >= least]
            at = at[~(buckets[at, :band] == buckets[x, :band]).any(1)]
            told = whole[at] & whole[x]
            out += [(x, y, False) for y in at[~told].tolist()]
            at = at[told]
            if not len(at):
                continue
            own, flat = sets[x], np.concatenate([sets[y] for y in at.tolist()])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[at]) - n[at])
            for y in at[100 * both >= percent * (n[at] + n[x] - both)].tolist():
                if label[y] != label[x]:
                    out.append((x, y, True))
                    label[label == label[y]] = label[x]
        x, y, sure = (np.array(v, t) for v, t in zip(zip(*out, strict=True), (np.int64, np.int64, bool), strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        return pa.table({"a": np.minimum(k[x], k[y]), "b": np.maximum(k[x], k[y]), "sure": sure})
    return run


def near_literals(literals: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``s``, ``n_shingles``, ``component`` (smallest connected ``s``) and ``kept`` for every distinct literal (subject and text).

    Two literals are linked if 100 * shared shingles >= ``percent`` * shingles of either (at least 80 is what the bands are made for). Texts that are
    NULL, empty or without words have no shingles and are linked with nothing. Rows that repeat subject and text are one literal; literals of
    one subject with different texts are rows of their own, ordered by a hash of the text. NULL subjects come first.
    """
    base, _, unique = keyed(as_literals(literals), "s", "o")
    base = base if unique else base.dropDuplicates(["k"])
    whole = near_classes(base, width, percent)
    names = base.select("k", "s")
    return whole.join(names, "k").join(names.select(F.col("k").alias("c"), F.col("s").alias("component")), "c").select(
        "s", "n_shingles", "component", (F.col("k") == F.col("c")).alias("kept"))


def near_classes(base: DataFrame, width: int, percent: int) -> DataFrame:
    """``k``, ``n_shingles`` and ``c`` (smallest connected key) for every key of numbered literals, of which no two share a key."""
    sketches = cut_lineage(base.select("k", "o").mapInArrow(_sketch(width), "k long, n long, sig1 long, sig2 long, sketch binary"))
    sets = ["sig1", "sig2", "n"]
    full = sketches.where("n > 0")
    classes = cut_lineage(full.groupBy(*sets).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    members = cut_lineage(full.select("k", *sets).join(classes, sets).select("k", "rep"))
    reps = full.select("k", "n", "sketch").join(members.where("k <> rep").select("k"), "k", "left_anti")
    bands = reps.select("k", "sketch").mapInArrow(_bands, "k long, bh long")
    common = bands.groupBy("bh").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("bh")
    shared = cut_lineage(bands.join(common, "bh"))
    sizes = sketches.select("k", "n")

    def linked(pairs: DataFrame) -> DataFrame:
        r = lambda x: full.select(F.col("k").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x))
        alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        likely = pairs.join(r("a"), "a").join(r("b"), "b").where(alike).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(
            _estimated(percent / 100 - MARGIN), "a long, b long")
        return confirmed(likely, base, sizes, width, percent)

    def settled(rest: DataFrame) -> DataFrame:
        sent = F.when(F.col("n") <= WHOLE, F.col("n")).otherwise(0)
        weight = rest.join(sizes, "k").groupBy("bh").agg(F.greatest(F.ceil(F.max("m") / BLOCK), F.ceil(8 * F.sum(sent) / SET_BYTES)).alias("blocks"))
        bodies = base.select("k", "o").join(rest.select("k").distinct(), "k").mapInArrow(_bodies(width), "k long, body binary")
        members = rest.join(weight, "bh").join(full.select("k", "n", "sketch").join(bodies, "k"), "k")
        members = in_blocks(members, F.col("blocks")).select("bh", "i", "j", "left", "k", "c", "n", "sketch", "body")
        return members.groupBy("bh", "i", "j").applyInArrow(_links(percent), "a long, b long, sure boolean")

    label = groups(shared, linked, settled, one_first=True)
    whole = sketches.select("k", F.col("n").alias("n_shingles")).join(members, "k", "left").select("k", "n_shingles", F.coalesce("rep", "k").alias("rep"))
    if label is None:
        return whole.select("k", "n_shingles", F.col("rep").alias("c"))
    # A class is named by its smallest member, so the smallest label of a component is its smallest key.
    return whole.join(label.select(F.col("k").alias("rep"), "c"), "rep", "left").select("k", "n_shingles", F.coalesce("c", "rep").alias("c"))
