"""Exact top-k search by inner product over integer vectors, with MaxScore.

A query's terms are its non-zero dimensions; the posting list of a dimension holds the candidates' values there. Within a shard
the largest contribution of every term is known. Terms in order of that bound are essential until the others together
cannot lift a candidate from nothing over the k-th best score known so far; the essential lists are traversed, by a block of queries at once, the
others are looked up for candidates that can still compete, or traversed too where these are many. What the shards find is merged.

The library has no vectors of its own; the operator takes any ``s`` and ``vector``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleframe.plans.support import cut_lineage

SHARD = 4_096
BLOCK = 256


def whole(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``s`` and ``v``: each component times ``scale``, rounded down. Vectors that are NULL or hold a NULL, NaN or infinite component go."""
    x = F.col("vector").cast("array<double>")
    good = F.col("vector").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("s", "vector").where(good).select("s", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def search_shard(lists: np.ndarray, names: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of a shard for each query: the query's row of ``q``, the candidate and the score. Posting lists are the rows of ``lists``.

    All queries traverse a list at once. Which lists are essential goes by their bounds for all queries, the floor by those of each query.
    """
    n = lists.shape[1]
    high, low = lists.max(1, initial=0), lists.min(1, initial=0)
    # Floating point where that is exact, else integers.
    top = int(np.abs(q).max(initial=0)) * max(int(high.max(initial=0)), -int(low.min(initial=0))) * max(len(lists), 1)
    kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
    lists, q, high, low = (x.astype(kind) for x in (lists, q, high, low))
    bound = np.maximum(q * high, q * low)
    order = np.argsort((np.minimum(q * high, q * low) - bound).sum(0), kind="stable")  # the widest ranges first
    first, rest = np.split(order, [len(order) - len(order) // 4])
    score = q[:, first] @ lists[first]
    nothing = kind(-(1 << 62))
    mine = np.flatnonzero(np.isin(names, own))
    x, y = np.nonzero(own[:, None] == names[mine][None, :])
    score[x, mine[y]] = nothing
    at, cand = np.nonzero(score > nothing)
    if n > k:
        # Finish the k most promising: their exact scores are a floor for the k-th best.
        lead = np.argpartition(score, n - k, axis=1)[:, n - k:]
        exact = np.take_along_axis(score, lead, 1)
        for d in rest:
            exact = np.where(exact > nothing, exact + q[:, d, None] * lists[d][lead], nothing)
        floor = exact.min(1)[:, None]
        alive = (score > nothing) & (score + bound[:, rest].sum(1)[:, None] >= floor)
        if 64 * np.count_nonzero(alive) > alive.size:  # looking up so many costs more than traversing the lists
            total = score + q[:, rest] @ lists[rest]
            at, cand = np.nonzero(alive & (total >= floor))
            found = total[at, cand]
        else:
            at, cand = np.nonzero(alive)
            found = score[at, cand] + (q[at][:, rest] * lists[rest][:, cand].T).sum(1)
    else:
        found = score[at, cand] + (q[at][:, rest] * lists[rest][:, cand].T).sum(1)
    found = found.astype(np.int64)
    by = np.lexsort((names[cand], -found, at))
    at, cand, found = at[by], cand[by], found[by]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], cand[keep], found[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query``, ``rank`` (from 1), ``s`` and ``score``: the ``k`` rows of ``vectors`` that score best for each row of ``queries``.

    Both have ``s`` and ``vector``; a row is no candidate for a query of its own ``s``. Ties go to the smaller ``s``; rows without ``s`` take no part,
    repeated rows of ``vectors`` take part each, missing components count as zero, and with fewer candidates all are returned. Scores must
    stay below 2^62. Shards of ``shard`` candidates meet blocks of ``block`` queries; a task holds one of each.
    """
    rows = cut_lineage(whole(vectors, scale).where("s is not null"))
    asked = whole(queries, scale).where("s is not null")
    n, kind = rows.count(), rows.schema["s"].dataType.simpleString()
    shards = max(1, -(-n // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("s", "v"), F.lit(shards)).cast("int"))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct("s", "v")).alias("q"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sides = rows.groupBy("shard").agg(F.collect_list(F.struct("s", "v")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cand, qs = batch.column("c").slice(i, 1).flatten(), batch.column("q").slice(i, 1).flatten()
                x, y = _matrix(cand.field("v")), _matrix(qs.field("v"))
                width = max(x.shape[1], y.shape[1])
                lists = np.ascontiguousarray(np.pad(x, ((0, 0), (0, width - x.shape[1]))).T)
                y = np.pad(y, ((0, 0), (0, width - y.shape[1])))
                names, own = cand.field("s").to_numpy(zero_copy_only=False), qs.field("s").to_numpy(zero_copy_only=False)
                at, found, score = search_shard(lists, names, y, own, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[at], type=qs.field("s").type), pa.array(names[found], type=cand.field("s").type), pa.array(score)],
                                                 names=["query", "s", "score"])

    found = asked.join(sides, "shard").select("q", "c").mapInArrow(run, f"query {kind}, s {kind}, score long")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "s")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "s", "score")
