"""Packing literals into training sequences of balanced attention cost.

A piece of n tokens costs a n + b n^2. Whole sequences are cut off texts that are longer than one; what is left is
assigned in descending order to the sequence of lowest cost that still has room. Pieces that fit nowhere are cut to fill the
gaps, and the tokens left over make sequences whose lengths are powers of two, so nothing is padded.

Every task packs its own rows in groups, without a shuffle; a group is bounded by its texts' bytes and count.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.rows import literals as plain
from tripleframe.llm.tokens import encoder

GROUP = 4096
GROUP_BYTES = 8 << 20
END = 0


def balance(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> np.ndarray:
    """Rows (text, start, length, sequence, offset) that place every token of texts of the given lengths."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for i, n in enumerate(lengths.tolist()):
        for at in range(n // capacity):
            out.append((i, at * capacity, capacity, seq, 0))
            seq += 1
    rest = lengths % capacity
    full = int(rest.sum()) // capacity
    cost, room, later = np.zeros(full), np.full(full, capacity), []
    for i in np.argsort(-rest, kind="stable"):
        n = int(rest[i])
        if n == 0:
            break
        start = int(lengths[i]) - n
        best = int(np.where(room >= n, cost, np.inf).argmin()) if full else 0
        if not full or room[best] < n:
            later.append([int(i), start, n])
            continue
        out.append((int(i), start, n, seq + best, capacity - int(room[best])))
        room[best] -= n
        cost[best] += linear * n + quadratic * n * n
    left = sum(x[2] for x in later) - int(room.sum())
    tail = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    gaps = [(int(q), capacity - int(room[q]), int(room[q])) for q in np.argsort(cost, kind="stable") if room[q]]
    gaps += [(full + j, 0, n) for j, n in enumerate(tail)]
    later.reverse()
    for q, offset, n in gaps:
        while n:
            i, start, m = later[-1]
            take = min(n, m)
            out.append((i, start, take, seq + q, offset))
            offset, n = offset + take, n - take
            if take == m:
                later.pop()
            else:
                later[-1] = [i, start + take, m - take]
    return np.array(out, np.int64).reshape(-1, 5)


def pack_literals(literals: DataFrame, tokenizer: str, capacity: int = 1024, end: int = END) -> DataFrame:
    """Pieces ``s``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A text's tokens are its ids by the vocabulary file ``tokenizer``, special tokens of that file in it included, and then ``end``; a NULL or empty text has only that
    one. Each row is packed, repeats and NULL subjects as well; an empty frame gives no rows. ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    lits = plain(literals)
    s_type = lits.schema["s"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seq = encoder(tokenizer, True), TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            both = pa.Table.from_batches(held).combine_chunks()
            raw, counts = encode(both.column("o").to_pylist())
            lengths = counts + 1
            ends = np.cumsum(lengths)
            ids = np.full(int(ends[-1]), end, np.uint32)
            ids[np.arange(len(raw)) + np.repeat(np.arange(len(counts)), counts)] = raw
            p = balance(lengths, capacity)
            p[:, 3] += seq
            seq = int(p[:, 3].max()) + 1
            at = (ends - lengths)[p[:, 0]] + p[:, 1]
            cut = [ids[a:a + n].tobytes() for a, n in zip(at, p[:, 2], strict=True)]
            cols = [both.column("s").take(pa.array(p[:, 0])).combine_chunks(), pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(cut, pa.binary()),
                    pa.array(lengths[p[:, 0]]), pa.array(p[:, 3]), pa.array(p[:, 4])]
            return pa.RecordBatch.from_arrays(cols, names=["s", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            at = 0
            sizes = pc.binary_length(batch.column("o")).to_pylist()
            for i in range(len(batch)):
                if rows and (rows >= GROUP or size + sizes[i] > GROUP_BYTES):
                    held.append(batch.slice(at, i - at))
                    yield flush()
                    held.clear()
                    rows = size = 0
                    at = i
                rows, size = rows + 1, size + sizes[i]
            held.append(batch.slice(at))
        if rows:
            yield flush()

    return lits.select("s", F.col("o")).mapInArrow(
        run, f"s {s_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
