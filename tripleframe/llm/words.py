"""Words of many texts at once: where they are and a 64-bit hash of each, with numpy.

A word is a run of bytes other than space and U+0009 to U+000D, as ``bytes.split()`` cuts them. Equal words have equal
hashes wherever they stand; hashes of different words differ but for a chance of about 2^-60.
"""
from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

PIECE = 1 << 17
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    hashes: np.ndarray  # uint64
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int, base: int = _R) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(PIECE, n).bit_length() if n > PIECE else PIECE + 1
    return _powers(size, base)


def _piece(buf: np.ndarray) -> Words:
    gap = np.ones(len(buf) + 2, bool)
    np.take(SPACE, buf, out=gap[1:-1], mode="clip")
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    value = buf.astype(np.uint64)
    value += np.uint64(1)
    value *= up[:len(buf)]
    np.cumsum(value, out=total[1:])
    return Words(mix((total[ends] - total[starts]) * down[starts]), starts, ends)


def words(data: bytes) -> Words:
    buf = np.frombuffer(data, np.uint8)
    if len(buf) <= PIECE:
        return _piece(buf)
    out, at = [], 0
    while at < len(buf):
        to = at + PIECE
        while to < len(buf):  # a piece ends at a gap, so that no word is cut
            gaps = np.flatnonzero(SPACE[buf[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to += PIECE
        w = _piece(buf[at:to])
        out.append(Words(w.hashes, w.starts + at, w.ends + at))
        at = min(to, len(buf))
    return Words(*(np.concatenate(x) for x in zip(*out, strict=True)))


class Batch(NamedTuple):
    """Words of several texts one after the other; text i has words ``first[i]`` to ``first[i + 1]``."""
    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """The text each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def position(self) -> np.ndarray:
        """The place of each word in its text."""
        return np.arange(len(self.hashes)) - np.repeat(self.first[:-1], np.diff(self.first))


def batch(texts: list[bytes]) -> Batch:
    data = b"\n".join(texts)
    w = words(data)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return Batch(data, w.hashes, w.starts, w.ends, np.searchsorted(w.starts, begin))


def rolling(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of every run of ``width`` values; run i starts at value i."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1, base)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[width:] - total[:n - width + 1]) * down[:n - width + 1])
