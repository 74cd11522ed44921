"""Literals that share nearly all their word n-grams: an exact Jaccard join by vertical partitioning.

The n-grams of all literals have one order, that of a 64-bit hash. It is cut into fragments, and a literal's set becomes a row of segments.

* Candidates. Sets of nearly equal size that are similar enough differ in at most d n-grams, so of d + 1 + e fragments at least e + 1 hold the
  same segment of both. Segments that are equal meet by their hash. How many fragments there are depends on a class of sizes; a set that may be
  similar to sets of the next class is cut for both. A segment without n-grams tells nothing; the few sets with more than e of them could
  have only such in common, so they also meet by their first n-grams in the order, as far as similar sets must share one.
* Counting. A pair's fragments are counted apart, in whatever tasks they fall, and the counts are summed per pair (``near_groups.confirmed``).

Equal sets are one class from the start, and buckets are held against single members first (``near_groups.groups``), so many copies make neither
many pairs nor large groups; no link between different sets is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.llm import words as W
from tripleframe.llm.near_groups import PIECE_BYTES, apart, confirmed, groups, shingle_sets
from tripleframe.llm.rows import keyed, texts
from tripleframe.plans.support import cut_lineage

_SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99)


def size_classes(percent: int, top: int) -> np.ndarray:
    """Smallest sizes of the classes, rising from 1, up to two beyond ``top``. A set is similar to sets of its own class and of those next to it."""
    step, out = max(1.4, 105 / percent), [1]
    while len(out) < 3 or out[-3] <= top:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * step))))
    return np.array(out)


def difference(size: int, percent: int) -> int:
    """How many n-grams two similar sets of at most ``size`` each may not share."""
    return 2 * size * (100 - percent) // (100 + percent)


def _segments(h: np.ndarray, own: np.ndarray, n: np.ndarray, tag: int, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and keys of the segments of some sets (``h`` rising within each) for a class of sets of at most ``size``."""
    apart = difference(size, percent)
    spare = 1 + apart // 32
    parts = apart + 1 + spare
    mark = W.mix(np.uint64(tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.arange(parts + 1, dtype=np.uint64))
    part = (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    cell = own * parts + part
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    total = np.add.reduceat(W.mix(h ^ np.uint64(_SALTS[0])), begin)
    owners, keys = [cell[begin] // parts], [W.mix(total ^ mark[cell[begin] % parts])]
    # With so many empty segments, two sets may have nothing else in common: they meet by their first n-grams.
    who = np.flatnonzero(parts - np.bincount(owners[0], minlength=len(n)) > spare)
    if len(who):
        start, take = (np.cumsum(n) - n)[who], (n - (percent * n + 99) // 100 + 1)[who]
        at = np.repeat(start - (np.cumsum(take) - take), take) + np.arange(take.sum())
        owners.append(np.repeat(who, take))
        keys.append(W.mix(W.mix(h[at] ^ np.uint64(_SALTS[1])) ^ mark[-1]))
    return np.concatenate(owners), np.concatenate(keys)


def bucket_keys(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and bucket keys of sets; two similar sets that are not equal have a key in common."""
    n = np.diff(first)
    classes = size_classes(percent, int(n.max(initial=1)))
    of = np.searchsorted(classes, n, "right") - 1
    owners, keys = [], []
    for tag in range(len(classes) - 1):
        size = int(classes[tag + 1]) - 1
        mine = (of == tag) | ((of == tag - 1) & (100 * n >= percent * int(classes[tag])))
        mine = np.flatnonzero(mine & (n > 0))
        if not len(mine) or difference(size, percent) == 0:
            continue  # similar sets of that size are equal
        at = np.repeat(first[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine]) + np.arange(n[mine].sum())
        own, key = _segments(h[at], np.repeat(np.arange(len(mine)), n[mine]), n[mine], tag, size, percent)
        owners.append(mine[own])
        keys.append(key)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def _described(width: int, percent: int):
    """Size, signature and bucket keys of every literal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches, PIECE_BYTES):
            h, first = shingle_sets(os, width)
            n = np.diff(first)
            sums = [np.zeros(len(n), np.uint64) for _ in _SALTS]
            for s, salt in zip(sums, _SALTS, strict=True):
                if len(h):
                    s[n > 0] = np.add.reduceat(W.mix(h ^ np.uint64(salt)), first[:-1][n > 0])
            own, key = bucket_keys(h, first, percent)
            order = np.argsort(own, kind="stable")
            key, edge = key[order].view(np.int64), np.searchsorted(own[order], np.arange(len(n) + 1))
            keys = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(key))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), keys],
                                             names=["k", "n", "sig1", "sig2", "bh"])
    return run


def _parities(width: int):
    """Which of many bits are set by an odd number of a set's n-grams; about two bits for each n-gram of a set of middling size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches, PIECE_BYTES):
            h, first = shingle_sets(os, width)
            out = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                out.append(np.packbits(np.bincount(W.mix(h[a:b]) >> np.uint64(54), minlength=1024).astype(np.uint8) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(out, pa.binary())], names=["k", "n", "sketch"])
    return run


def _may_differ(percent: int):
    """Pairs whose parities do not show that they differ in too many n-grams."""
    def fit(na: np.ndarray, nb: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
        out = np.empty((len(x), len(y)), bool)
        for i in range(len(x)):
            apart = np.bitwise_count(y ^ x[i]).sum(1)
            both = na[i] + nb
            need = (percent * both + 99 + percent) // (100 + percent)
            out[i] = (apart <= both - 2 * need) & (np.minimum(na[i], nb) >= need)
        return out
    return fit


def literal_records(triples: DataFrame) -> DataFrame:
    """Literals among triples as ``s`` and ``o``; with a column ``p``, ``s`` is a struct of subject and predicate.

    Objects that are IRIs (``o_kind`` = 'iri') are left out; without ``o_kind`` every object is a literal.
    """
    rows = triples.where(F.col("o_kind") == "lit") if "o_kind" in triples.columns else triples
    s = F.struct(F.col("s").alias("s"), F.col("p").alias("p")) if "p" in triples.columns else F.col("s")
    return rows.select(s.alias("s"), F.coalesce(F.col("o").cast("string"), F.lit("")).alias("o"))


def similar_literals(triples: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``s``, ``p``, ``n_grams``, ``component_s`` and ``component_p`` of every literal of ``triples``; those of one component are connected by links.

    Takes triples (``s``, ``p``, ``o``, ``o_kind``; further columns are passed over, whatever they are called) or only ``s`` and ``o``; without ``p`` the result
    has none either. A literal's set are the distinct n-grams of ``width`` of its words (runs other than space and U+0009 to U+000D, A to Z in lower case); with
    fewer words, the whole is one. Two literals are linked if 100 * common n-grams >= ``percent`` * n-grams of either. ``component_s`` and
    ``component_p`` name the smallest literal that links lead to, itself included, in the order of subject, predicate and a hash of the text, NULL first.

    Literals that are NULL, empty or without words have no n-grams and are linked with nothing. Rows that repeat subject, predicate and text are one
    literal (language and type aside) and one row; one subject's literals with different texts are rows of their own. No triples, no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    base, _, unique = keyed(literal_records(triples), "s", "o")
    base = base if unique else base.dropDuplicates(["k"])
    found = literal_classes(base, width, percent)
    names = base.select("k", "s")
    out = found.join(names, "k").join(names.select(F.col("k").alias("c"), F.col("s").alias("c_s")), "c")
    if not isinstance(base.schema["s"].dataType, T.StructType):
        return out.select("s", F.col("n").alias("n_grams"), F.col("c_s").alias("component_s"))
    return out.select("s.s", "s.p", F.col("n").alias("n_grams"), F.col("c_s.s").alias("component_s"), F.col("c_s.p").alias("component_p"))


def literal_classes(base: DataFrame, width: int, percent: int) -> DataFrame:
    """``k``, ``n`` and ``c`` (smallest connected key) for every key of numbered literals, of which no two share a key."""
    rows = cut_lineage(base.select("k", "o").mapInArrow(_described(width, percent), "k long, n long, sig1 long, sig2 long, bh array<long>"))
    sets = ["sig1", "sig2", "n"]
    full = rows.where("n > 0")
    classes = cut_lineage(full.groupBy(*sets).agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    members = cut_lineage(full.select("k", *sets).join(classes, sets).select("k", "rep"))
    reps = full.join(members.where("k <> rep").select("k"), "k", "left_anti")
    buckets = reps.select("k", F.explode("bh").alias("bh"))
    common = buckets.groupBy("bh").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("bh")
    shared = cut_lineage(buckets.join(common, "bh"))
    sizes = rows.select("k", "n")

    def parities(keys: DataFrame) -> DataFrame:
        return base.join(keys, "k").select("k", "o").mapInArrow(_parities(width), "k long, n long, sketch binary")

    label = groups(shared, lambda pairs: confirmed(pairs, base, sizes, width, percent), lambda rest: apart(rest, parities, _may_differ(percent)))
    whole = rows.select("k", "n").join(members, "k", "left").select("k", "n", F.coalesce("rep", "k").alias("rep"))
    if label is None:
        return whole.select("k", "n", F.col("rep").alias("c"))
    # A class is named by its smallest member, so the smallest label of a component is its smallest key.
    return whole.join(label.select(F.col("k").alias("rep"), "c"), "rep", "left").select("k", "n", F.coalesce("c", "rep").alias("c"))
