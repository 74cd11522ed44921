"""Places in texts, packed as arrays for a shuffle: a row holds what one batch has for one bucket of hashes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BUCKET_WORDS = 16_000_000


def bucket_count(chars: int) -> int:
    """Buckets of up to ``BUCKET_WORDS``, more of smaller ones while data are small."""
    n = max(chars, 1) / 6
    return int(max(1, n / BUCKET_WORDS, (n / 10_000) ** 0.5))


def pack(text: np.ndarray, pos: np.ndarray, ks: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places (in order of text and position): the texts' keys, how many places each has, and gaps of positions, byte plane by byte plane."""
    if not len(text):
        return b"", b"", b""
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    gap = np.diff(pos, prepend=0)
    gap[begin] = pos[begin]
    return (ks[text[begin]].tobytes(), np.diff(begin, append=len(text)).astype(np.uint32).tobytes(),
            gap.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(docs: bytes, counts: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of packed places."""
    counts = np.frombuffer(counts, np.uint32).astype(np.int64)
    gap = np.ascontiguousarray(np.frombuffer(pos, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
    total = np.cumsum(gap)
    begin = np.cumsum(counts) - counts
    return np.repeat(np.frombuffer(docs, np.int64), counts), total - np.repeat(total[begin] - gap[begin], counts)


def places(keys: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """A row (key, positions) per key."""
    order = np.lexsort((pos, keys))
    keys, pos = keys[order], pos[order]
    begin = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0)) if len(keys) else np.zeros(0, int)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)), pa.int32()), pa.array(pos.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(keys[begin], pa.int64()), lists], names=["k", "pos"])
