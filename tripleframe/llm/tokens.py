"""Token ids of texts for a byte-level BPE vocabulary, with every distinct word merged once.

The vocabulary is a file in the format of the ``tokenizers`` library, cut by :data:`PATTERN` whatever pattern the file names; the ids equal those that
library gives (a test compares them). Special tokens in a text are ordinary text, or their own ids if ``special`` is asked for. The pattern of such vocabularies always starts a new piece at a
space that stands between two other characters, so words cut there can be merged apart and looked up again.
"""
from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

# Fixed value: the pattern that byte-level BPE vocabularies of this kind cut text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KNOWN = 400_000  # words whose ids a worker remembers
_ODD = re.compile(r"^ |\s | \s| $")


def _bytes_of() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str, special: bool = False):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to_byte, added = _bytes_of(), {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
        self._bpe = tiktoken.Encoding("graph", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self._special = sorted(added) if special else []
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self._size[i] = len(token)
        self._forget()

    def _forget(self):
        self._place: dict[str, int] = {"": 0}
        self._starts, self._counts, self._pool, self._used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _learn(self, new: list[str]) -> None:
        text = " " + " ".join(new)
        ids = np.array(self._bpe.encode_ordinary(text), np.uint32)
        ends = np.cumsum(np.array([len(w.encode()) + 1 for w in new]))
        cut = np.searchsorted(np.cumsum(self._size[ids]), ends, "left") + 1
        at = len(self._place)
        self._place.update(zip(new, range(at, at + len(new)), strict=True))
        while len(self._starts) < at + len(new):
            self._starts, self._counts = np.concatenate([self._starts] * 2), np.concatenate([self._counts] * 2)
        while len(self._pool) < self._used + len(ids):
            self._pool = np.concatenate([self._pool] * 2)
        self._starts[at:at + len(new)] = self._used + np.concatenate([[0], cut[:-1]])
        self._counts[at:at + len(new)] = np.diff(cut, prepend=0)
        self._pool[self._used:self._used + len(ids)] = ids
        self._used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        marked = [any(x in t for x in self._special) for t in texts]
        odd = [m or _ODD.search(t) is not None for m, t in zip(marked, texts, strict=True)]
        cut = pc.split_pattern(pa.array(["" if x else t for x, t in zip(odd, texts, strict=True)], pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self._place) > _KNOWN:
            self._forget()
        if new := [w for w in names if w not in self._place]:
            self._learn(new)
        at = np.array([self._place[w] for w in names], np.int64)[words.indices.to_numpy()]
        starts, counts = self._starts[at], self._counts[at]
        # The first word of a text has no space in front, and an odd text is one word: both are encoded as they are.
        heads = [self._bpe.encode(t, allowed_special="all") if m else self._bpe.encode_ordinary(t if x else t.split(" ", 1)[0]) for m, x, t in zip(marked, odd, texts, strict=True)]
        sizes = np.array([len(h) for h in heads], np.int64)
        starts[offsets[:-1]] = self._used + np.cumsum(sizes) - sizes
        counts[offsets[:-1]] = sizes
        pool = np.concatenate([self._pool[:self._used], np.array([i for h in heads for i in h], np.uint32)])
        total = np.cumsum(counts)
        where = np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)
        ends = total[offsets[1:] - 1] if len(texts) else np.zeros(0, np.int64)
        return pool[where], np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)
