"""Passages that repeat word for word, within a literal or across literals, and their removal.

Fixed-block anchors. Every literal is cut into blocks of ``window // 2`` words that do not overlap: the index. Every rolling run of that many words
probes it. A repeated window of ``window`` words holds a whole block of either copy, and that block is hit by the other copy's probe, so
hits at another place than the block's own mark everything that can repeat. Around hits, windows are extended to their full
length and compared as such; of equal windows the first stays. Runs of repeated windows are the maximal exact repeats.

How it is spread: hashes go to buckets, packed as arrays (about seven bytes a word), in one shuffle. What repeats inside a batch is settled
there, so a passage that is everywhere sends one entry per batch. Later copies need not be told that they are not the first; only first
windows are sent back. Texts are shuffled once by key.

Windows are equal if a 64-bit hash and a bucket number drawn from another hash are; blocks are only candidates, so 32 bits do.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import words as W
from tripleframe.llm.packed import bucket_count, pack, places, unpack
from tripleframe.llm.rows import numbered, texts

WINDOW = 20
_OTHER = 0xC2B2AE3D27D4EB4F
_PACKED = "b int, docs binary, counts binary, pos binary, value binary, known_docs binary, known_counts binary, known_pos binary, blocks binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)


def _probes(block: int, buckets: int):
    """Packed probes, blocks and hits that a batch settles by itself, a row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches):
            ks = np.array(ks, np.int64)
            b = W.batch(os)
            h, text, pos = W.rolling(b.hashes, block), b.text, b.position
            ok = text[:len(h)] == text[block - 1:] if len(h) else np.zeros(0, bool)
            h, text, pos = h[ok], text[:len(ok)][ok], pos[:len(ok)][ok]
            if not len(h):
                continue
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, text, pos, bucket = h[order], text[order], pos[order], bucket[order]
            _, group, count = np.unique(h, return_inverse=True, return_counts=True)
            own = pos % block == 0
            blocks = np.bincount(group[own], minlength=len(count))
            # A block is known as a hit if another one equals it; any other run if a block of the batch does.
            known = blocks[group] > own
            first = np.zeros(len(h), bool)
            at = np.flatnonzero(own)
            first[at[np.unique(group[at], return_index=True)[1]]] = True
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            value = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = []
            for i in np.flatnonzero(np.diff(edge)):
                s = slice(edge[i], edge[i + 1])
                k, f = known[s], first[s]
                many = (blocks[group[s][f]] > 1).astype(np.uint8)
                rows.append((int(i), *pack(text[s][~k], pos[s][~k], ks), value[s][~k].tobytes(), *pack(text[s][k], pos[s][k], ks), value[s][f].tobytes() + many.tobytes()))
            yield _rows(rows)
    return run


def _hits(block: int):
    def run(rows: pa.Table) -> pa.Table:
        got = [np.frombuffer(x, np.uint8) for x in rows.column("blocks").to_pylist()]
        value = np.concatenate([x[:len(x) // 5 * 4].view(np.uint32) for x in got])
        many = np.concatenate([x[len(x) // 5 * 4:] for x in got])
        index, group, count = np.unique(value, return_inverse=True, return_counts=True)
        twice = (count > 1) | (np.bincount(group, many, len(index)) > 0)
        ks, ps = [], []
        for row in rows.select(_NAMES[1:-1]).to_pylist():
            v = np.frombuffer(row["value"], np.uint32)
            if len(v) and len(index):
                keys, pos = unpack(row["docs"], row["counts"], row["pos"])
                at = np.minimum(np.searchsorted(index, v), len(index) - 1)
                hit = (index[at] == v) & ((pos % block != 0) | twice[at])
                ks.append(keys[hit])
                ps.append(pos[hit])
            if row["known_docs"]:
                keys, pos = unpack(row["known_docs"], row["known_counts"], row["known_pos"])
                ks.append(keys)
                ps.append(pos)
        ks, ps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ks, ps))
        return pa.Table.from_batches([places(ks, ps)])
    return run


def _around(hits: list[np.ndarray], sizes: np.ndarray, first: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts, among the words of a batch, of the windows that hold a hit and lie in their text."""
    n = int(first[-1])
    step = np.zeros(n + window + 2, np.int64)
    for h, size, at in zip(hits, sizes, first[:-1], strict=True):
        if h is not None and size >= window:
            lo, hi = np.maximum(h - (window - block), 0), np.minimum(h, size - window)
            good = lo <= hi
            np.add.at(step, at + lo[good], 1)
            np.add.at(step, at + hi[good] + 1, -1)
    return np.flatnonzero(np.cumsum(step)[:n] > 0)


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    return [None if v is None else np.array(v, np.int64) for v in batch.column(name).to_pylist()]


def _candidates(block: int, window: int, buckets: int):
    """Packed windows around hits, the first of equal ones in a batch, a row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, rows in texts(batches):
            order = np.argsort(np.array(ks, np.int64), kind="stable")
            ks, hits = np.array(ks, np.int64)[order], _lists(rows, "hits")
            b = W.batch([os[i] for i in order])
            at = _around([hits[i] for i in order], np.diff(b.first), b.first, block, window)
            if not len(at):
                continue
            h, text, pos = W.rolling(b.hashes, window)[at], b.text[at], b.position[at]
            _, one = np.unique(h, return_index=True)
            one.sort()
            h, text, pos, at = h[one], text[one], pos[one], at[one]
            bucket = ((W.rolling(b.hashes, window, _OTHER)[at] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, text, pos, bucket = h[order], text[order], pos[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for i in np.flatnonzero(np.diff(edge)):
                s = slice(edge[i], edge[i + 1])
                out.append((int(i), *pack(text[s], pos[s], ks), h[s].tobytes(), b"", b"", b"", b""))
            yield _rows(out)
    return run


def _firsts(rows: pa.Table) -> pa.Table:
    """The first place of every window of a bucket."""
    parts = [(np.frombuffer(r["value"], np.uint64), *unpack(r["docs"], r["counts"], r["pos"])) for r in rows.select(["value", "docs", "counts", "pos"]).to_pylist()]
    h, keys, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, keys, h))
    new = np.ones(len(h), bool)
    new[1:] = np.diff(h[order]) != 0
    return pa.Table.from_batches([places(keys[order][new], pos[order][new])])


def _kept(block: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, os, rows in texts(batches):
            b = W.batch(os)
            hits, firsts = _lists(rows, "hits"), _lists(rows, "firsts")
            sizes = np.diff(b.first)
            again = np.zeros(int(b.first[-1]) + 1, bool)
            again[_around(hits, sizes, b.first, block, window)] = True
            for f, at in zip(firsts, b.first[:-1], strict=True):
                if f is not None:
                    again[f + at] = False
            at = np.flatnonzero(again)
            step = np.zeros(int(b.first[-1]) + window + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
            gone = np.cumsum(step)[:int(b.first[-1])] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
            removed, kept, starts, ends = [], [], [], []
            for i, o in enumerate(os):
                lo, hi = b.first[i], b.first[i + 1]
                cut = gone[lo:hi]
                removed.append(int(cut.sum()))
                parts = o.split()
                kept.append(b" ".join(parts if not removed[-1] else [parts[j] for j in np.flatnonzero(~cut)]))
                if removed[-1]:
                    d = np.flatnonzero(np.diff(np.concatenate([[False], cut, [False]]).view(np.int8)))
                    starts.append(d[::2])
                    ends.append(d[1::2])
                else:
                    starts.append([])
                    ends.append([])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("s"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                                              pa.array(starts, kind), pa.array(ends, kind)], names=["s", "n_words", "n_removed", "o", "starts", "ends"])
    return run


def drop_repeats(literals: DataFrame, window: int = WINDOW) -> DataFrame:
    """``s``, ``n_words``, ``n_removed``, the kept words as ``o``, and the removed runs of words ``starts`` to ``ends``, for every row.

    A word goes if a window of ``window`` words around it also starts earlier: in a smaller ``s``, or before it in the same literal. Windows are
    judged on the input. A NULL text has no words. NULL subjects come first; rows that repeat subject and text are one literal and all get its
    result; other literals of one subject are ordered by a hash of their text. ``window`` is even and at least 2.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    block = window // 2
    base = numbered(literals).select("s", "o", "k")
    buckets = bucket_count(base.agg(F.sum(F.length("o"))).first()[0] or 0)
    kind = base.schema["s"].dataType.simpleString()
    lists = lambda rows, name: rows.groupBy("k").agg(F.flatten(F.collect_list("pos")).alias(name))
    packed = base.select("k", "o").mapInArrow(_probes(block, buckets), _PACKED)
    hits = lists(packed.groupBy("b").applyInArrow(_hits(block), "k long, pos array<int>"), "hits")
    near = base.join(hits, "k").select("s", "o", "k", "hits")
    firsts = lists(near.mapInArrow(_candidates(block, window, buckets), _PACKED).groupBy("b").applyInArrow(_firsts, "k long, pos array<int>"), "firsts")
    return base.join(hits, "k", "left").join(firsts, "k", "left").select("s", "o", "k", "hits", "firsts").mapInArrow(
        _kept(block, window), f"s {kind}, n_words long, n_removed long, o string, starts array<long>, ends array<long>")
