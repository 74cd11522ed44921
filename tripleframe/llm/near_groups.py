"""Groups of sets that links connect, from buckets of candidates, without all pairs of a bucket.

* Every member of a bucket is first held against one of them, the one with the smallest key, so that members of many common buckets still
  make one pair. What is linked gets a common label.
* Buckets that still hold several labels draw other members, one each, twice over.
* Members of buckets that are apart even then are compared block by block inside tasks, either on whole sets, so that only the links that connect
  what was apart leave the task, or by a bound that loses no link; then pairs that pass it leave the task.
* Pairs are confirmed on whole sets by vertical partitioning: the order of the shingles, by hash, is cut into fragments; a fragment of a set meets
  the same fragment of its partner in one task, which counts what both hold, and the counts are summed per pair. A set with many partners is
  sent once for every few hundred of them.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import words as W
from tripleframe.llm.rows import texts
from tripleframe.plans.support import cut_lineage

DRAWS = 2  # rounds of one comparison per member after the first
PARTNERS = 512  # of a set, in one task
FRAGMENT = 1024  # shingles of the larger set in a fragment, about
BLOCK = 512  # members of a bucket that are compared with as many others at once
FEW = 16  # buckets of up to this many members are compared by a join
BROADCAST_KEYS = 500_000  # of eight bytes
PIECE_BYTES = 2 << 20  # of text that is cut into shingles at once


def shingle_sets(os: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, one text after the other, and where each text's begin.

    A to Z count as lower case; a text of fewer words is one shingle, one without words has none.
    """
    b = W.batch([o.lower() for o in os])
    sizes = np.diff(b.first)
    h, text = W.rolling(b.hashes, width), b.text
    inside = text[:len(h)] == text[width - 1:] if len(h) else np.zeros(0, bool)
    h, own = h[inside], text[:len(inside)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    extra = np.array([W.rolling(b.hashes[b.first[i]:b.first[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)
    h, own = np.concatenate([h, W.mix(extra ^ np.uint64(0x5851F42D4C957F2D))]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(os) + 1))


def components(links: DataFrame) -> DataFrame:
    """``k`` and ``c``, the smallest key each key of ``links`` (``a``, ``b``) is connected with.

    Every key first takes its smallest neighbour, and links inside such groups go; mostly none is left. Otherwise every round takes
    the smallest label among neighbours and then the label of that label, so long chains take few rounds; a round is cut off by a checkpoint.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut_lineage(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("c")).select("k", F.least("k", "c").alias("c")))
    rest = contracted(links, label)
    if rest is None:
        return label
    both = cut_lineage(rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    outer = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("c")).select("k", F.least("k", "c").alias("c"))
    while True:
        near = both.join(outer.select(F.col("k").alias("b"), "c"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("m"))
        step = outer.join(near, "k").select("k", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        step = cut_lineage(step)
        jump = step.select(F.col("k").alias("c"), F.col("c").alias("c2"))
        outer = step.join(jump, "c").select("k", F.col("c2").alias("c"), "old")
        if outer.where("c <> old").limit(1).count() == 0:
            return relabelled(label, outer.select("k", "c"))
        outer = cut_lineage(outer.select("k", "c"))


def contracted(links: DataFrame, label: DataFrame) -> DataFrame | None:
    """Links between labels that differ, each once; None if there are none. A key without a label is its own."""
    mine = lambda x: label.select(F.col("k").alias(x), F.col("c").alias("c" + x))
    rest = links.join(mine("a"), "a", "left").join(mine("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x <> y")
    rest = cut_lineage(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return rest if rest.limit(1).count() else None


def relabelled(label: DataFrame, outer: DataFrame) -> DataFrame:
    """Labels after labels themselves got labels."""
    return cut_lineage(label.join(outer.select(F.col("k").alias("c"), F.col("c").alias("c2")), "c", "left").select("k", F.coalesce("c2", "c").alias("c")))


def merged(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels with further links; only links between groups are looked at again."""
    if label is None:
        return components(links) if links.limit(1).count() else None
    rest = contracted(links, label)
    if rest is None:
        return label
    outer = components(rest)
    fresh = outer.join(label.select("k"), "k", "left_anti")
    return cut_lineage(relabelled(label, outer).unionByName(fresh.select("k", "c")))


def groups(shared: DataFrame, linked: Callable[[DataFrame], DataFrame], settled: Callable[[DataFrame], DataFrame], one_first: bool = False) -> DataFrame | None:
    """``k`` and ``c`` of all keys that are linked with another one, or None.

    ``shared`` has the members ``k`` of buckets ``bh`` of at least two. ``linked`` takes pairs (``a``, ``b``) and returns those that are linked;
    ``settled`` takes members (``bh``, ``k``, label ``c``, size ``m``) of large buckets that are apart and returns pairs (``a``, ``b``, ``sure``): those that
    are ``sure`` are linked, the others are looked at by ``linked``, and together they connect what links connect. With ``one_first`` every member is
    held against one of the members that its buckets begin with before all those that it is not linked with by then; that spares most pairs
    where members share many buckets that begin differently.
    """
    pivots = shared.groupBy("bh").agg(F.min("k").alias("pivot"))
    pairs = shared.join(pivots, "bh").where("k <> pivot").select(F.col("k").alias("a"), F.col("pivot").alias("b"))
    if one_first:
        pairs = cut_lineage(pairs.distinct())
        label = merged(None, linked(pairs.groupBy("a").agg(F.min("b").alias("b"))))
        if label is not None:
            mine = lambda x: label.select(F.col("k").alias(x), F.col("c").alias("c" + x))
            pairs = pairs.join(mine("a"), "a", "left").join(mine("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        label = merged(label, linked(pairs))
    else:
        label = merged(None, linked(pairs.distinct()))

    def spread() -> DataFrame:
        if label is None:
            return shared.withColumn("c", F.col("k"))
        return shared.join(label, "k", "left").select("bh", "k", F.coalesce("c", "k").alias("c"))

    for draw in range(DRAWS):
        members = spread()
        drawn = F.min(F.struct(F.xxhash64("k", "bh", F.lit(draw)).alias("x"), F.col("k").alias("q"), F.col("c").alias("cq")))
        open_ = cut_lineage(members.groupBy("bh").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), drawn.alias("d"))
                            .where("lo <> hi and m > 2").select("bh", "d.q", "d.cq"))
        if open_.limit(1).count() == 0:
            break
        more = members.join(open_, "bh").where("c <> cq").select(F.least("k", "q").alias("a"), F.greatest("k", "q").alias("b")).distinct()
        label = merged(label, linked(more))
    members = spread()
    open_ = members.groupBy("bh").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi and m > 2").select("bh", "m")
    rest = cut_lineage(members.join(open_, "bh"))
    if rest.limit(1).count() == 0:
        return label
    few = rest.where(F.col("m") <= FEW)
    other = few.select("bh", F.col("k").alias("b"), F.col("c").alias("cb"))
    some = few.select("bh", F.col("k").alias("a"), "c").join(other, "bh").where("a < b and c <> cb").select("a", "b").distinct()
    many = rest.where(F.col("m") > FEW)
    if many.limit(1).count() == 0:
        return merged(label, linked(some))
    found = cut_lineage(settled(many))
    more = linked(some.unionByName(found.where("not sure").select("a", "b")).distinct())
    return merged(label, more.unionByName(found.where("sure").select("a", "b")))


def in_blocks(rest: DataFrame, blocks: Column) -> DataFrame:
    """Members of buckets once for every task (``bh``, ``i``, ``j``) in which two of the ``blocks`` of their bucket meet; ``left`` tells those of block ``i``."""
    mine = F.pmod(F.xxhash64("k", "bh"), "g").cast("int")
    rest = rest.withColumn("g", blocks.cast("int")).withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return rest.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "left": F.col("own") <= F.col("other")}).drop("m", "g", "own", "other")


def apart(rest: DataFrame, sketches: Callable[[DataFrame], DataFrame], may_link: Callable[[np.ndarray, np.ndarray, list, list], np.ndarray]) -> DataFrame:
    """Pairs (``a``, ``b``, none ``sure``) of members of one bucket with different labels that may be linked; buckets meet block by block.

    ``sketches`` gives ``k``, ``n`` and ``sketch`` of the keys it gets; ``may_link`` takes sizes and sketches of two sides and says which of all pairs may be
    linked, as a matrix.
    """
    rest = in_blocks(rest.join(sketches(rest.select("k").distinct()), "k"), F.ceil(F.col("m") / BLOCK))

    def run(rows: pa.Table) -> pa.Table:
        k, c, n = (rows.column(x).to_numpy() for x in ("k", "c", "n"))
        sketch, left = rows.column("sketch").to_pylist(), rows.column("left").to_numpy().astype(bool)
        one = bool(rows.column("i")[0].as_py() == rows.column("j")[0].as_py())
        a, b = np.arange(len(k)) if one else np.flatnonzero(left), np.arange(len(k)) if one else np.flatnonzero(~left)
        fit = may_link(n[a], n[b], [sketch[x] for x in a], [sketch[x] for x in b]) & (c[a][:, None] != c[b][None, :])
        x, y = np.nonzero(fit)
        x, y = k[a[x]], k[b[y]]
        if one:
            x, y = x[x < y], y[x < y]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return rest.groupBy("bh", "i", "j").applyInArrow(run, "a long, b long").withColumn("sure", F.lit(False))


# ---------------------------------------------------------------- counting on whole sets

def _routed(width: int):
    """Fragments of the sets of texts for every pivot that waits for them; ``role`` 0 is the pivot itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, rows in texts(batches, PIECE_BYTES):
            h, first = shingle_sets(os, width)
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            size = 0
            for i, roles in enumerate(rows.column("roles").to_pylist()):
                own = h[first[i]:first[i + 1]]
                for r in roles:
                    edge = np.searchsorted(own, np.array([(f << 64) // r["v"] for f in range(1, r["v"])], np.uint64))
                    edge = [0, *edge.tolist(), len(own)]
                    for f in range(r["v"]):
                        if edge[f + 1] > edge[f]:
                            for to, x in zip(out, (r["pivot"], r["salt"], f, r["role"], ks[i], len(own), own[edge[f]:edge[f + 1]].tobytes()), strict=True):
                                to.append(x)
                            size += edge[f + 1] - edge[f]
                    if size > 1 << 20:
                        yield _fragments(out)
                        out, size = ([], [], [], [], [], [], []), 0
            if size:
                yield _fragments(out)
    return run


_FRAGMENTS = "pivot long, salt int, f int, role int, k long, n long, body binary"


def _fragments(cols: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in _FRAGMENTS.split(", ")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What partners share with the pivot in front of them, fragment by fragment; rows come sorted."""
    at, own, own_n = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("pivot", "salt", "f")], 1)
        role, k, n, body = batch.column("role").to_numpy(), batch.column("k").to_numpy(), batch.column("n").to_numpy(), batch.column("body").to_pylist()
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        a, b, na, nb, both = [], [], [], [], []
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
            here = tuple(key[lo].tolist())
            if role[lo] == 0:
                at, own, own_n = here, np.frombuffer(body[lo], np.uint64), int(n[lo])
                lo += 1
            if at != here or lo == hi:
                continue
            flat = np.frombuffer(b"".join(body[lo:hi]), np.uint64)
            edge = np.cumsum([0, *(len(x) // 8 for x in body[lo:hi - 1])])
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            a.append(k[lo:hi])
            b.append(np.full(hi - lo, here[0]))
            na.append(n[lo:hi])
            nb.append(np.full(hi - lo, own_n))
            both.append(np.add.reduceat(hit.astype(np.int64), edge))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, na, nb, both)], names=["a", "b", "na", "nb", "both"])


def confirmed(pairs: DataFrame, base: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (``a``, ``b``) with 100 * shared >= ``percent`` * either, counted on the whole sets of ``base`` (``k``, ``o``).

    No two rows of ``base`` may share a key. ``sizes`` has ``k`` and ``n``, the size of its set. Pairs whose sizes alone rule that out are not counted.
    """
    size = lambda x: sizes.select(F.col("k").alias(x), F.col("n").alias("n" + x))
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = cut_lineage(pairs.select("a", "b", "nb"))
    if pairs.limit(1).count() == 0:
        return pairs.select("a", "b")
    heavy = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m"), F.max("nb").alias("nb")).select(
        "b", F.ceil(F.col("m") / PARTNERS).cast("int").alias("salts"), F.ceil(F.col("nb") / FRAGMENT).cast("int").alias("v"))
    role = lambda pivot, salt, of: F.struct(F.col(pivot).alias("pivot"), salt.cast("int").alias("salt"), F.col("v").alias("v"), F.lit(of).alias("role")).alias("r")
    partners = pairs.join(heavy, "b").select(F.col("a").alias("k"), role("b", F.pmod(F.xxhash64("a"), F.col("salts")), 1))
    pivots = heavy.select("b", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(F.col("b").alias("k"), role("b", F.col("salt"), 0))
    need = cut_lineage(partners.unionByName(pivots).groupBy("k").agg(F.collect_list("r").alias("roles")))
    few = need.agg(F.count(F.lit(1)) * 4 + F.sum(F.size("roles"))).first()[0] <= BROADCAST_KEYS
    parts = base.select("k", "o").join(F.broadcast(need) if few else need, "k").mapInArrow(_routed(width), _FRAGMENTS)
    parts = parts.repartition("pivot", "salt", "f").sortWithinPartitions("pivot", "salt", "f", "role")
    counts = parts.mapInArrow(_counted, "a long, b long, na long, nb long, both long")
    sums = counts.groupBy("a", "b").agg(F.sum("both").alias("both"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return cut_lineage(sums.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
