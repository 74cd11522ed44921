"""Language tags of literals, from hyperdimensional profiles of their letters.

Every letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) its three letter vectors, rotated by
2, 1 and 0 places so that order counts; a text's vector bundles (adds) those of all its trigrams. The bundle of all texts
of a language is its prototype; an untagged text gets the language whose prototype has the largest cosine with it.

Bundles are sums of whole numbers, so the prototypes do not depend on how rows are spread over tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1024
UNKNOWN = "@und"
_GROUP, _BLOCK = 1 << 19, 4096  # characters of a group of texts, trigrams of a block
_SLICE = 256  # texts whose vectors are held at once
LOW = 0.001  # share of the tagged texts of a language and length that may resemble it less than its bound asks
_SIZES = 32  # lengths by powers of two
_STEPS = 1000  # cosines are counted by thousandths


@lru_cache(maxsize=1 << 14)
def _letter(code: int, dims: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dims, np.int8) * 2 - 1


@lru_cache(maxsize=1 << 16)
def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams (rows of three code points), and for every trigram in the texts its text and its row, rows rising; no letters, no trigrams.

    Texts are lower-cased, and every run of other characters is one space, also at both ends.
    """
    low = [t.lower() for t in texts]
    flat = np.frombuffer(("\n" + "\n\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    codes = np.unique(flat)
    letter = np.array([_is_letter(int(c)) for c in codes])
    rank = np.where(letter, np.cumsum(letter), 0)  # 0: the space
    ids = rank[np.searchsorted(codes, flat)] if len(codes) > 4096 else _lookup(codes, rank, flat)
    edge = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in low], out=edge[1:])
    own = np.repeat(np.arange(len(texts)), np.diff(edge))
    keep = (ids > 0) | np.concatenate([[True], (ids[1:] == 0) & (ids[:-1] > 0)])
    keep[edge[:-1]] = True
    # a run of spaces keeps its first; the space in front of a text is kept unless letters never came
    ids, own = ids[keep], own[keep]
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    good = (own[:-2] == own[2:]) & (b > 0)
    size = int(letter.sum()) + 1
    gram, own = ((a * size + b) * size + c)[good], own[:-2][good]
    order = np.argsort(gram)
    gram, own = gram[order], own[order]
    new = np.diff(gram, prepend=-1) != 0
    used, row = gram[new], np.cumsum(new) - 1
    back = np.concatenate([[32], codes[letter]]).astype(np.int64)
    return np.stack([back[used // (size * size)], back[used // size % size], back[used % size]], 1), own, row


def _lookup(codes: np.ndarray, rank: np.ndarray, flat: np.ndarray) -> np.ndarray:
    table = np.zeros(int(codes[-1]) + 1, np.int64)
    table[codes] = rank
    return table[flat]


def bundles(texts: list[str], dims: int = DIMS, seed: int = 1) -> np.ndarray:
    """A vector for each text; zero for a text without letters."""
    return _bundles(texts, dims, seed)[0]


def _bundles(texts: list[str], dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, and how many letters each text has.

    Texts are taken in groups, a group's trigrams in blocks: what is held at once does not grow with the alphabet.
    """
    out, letter_counts, at = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= _GROUP):
            size += len(texts[to])
            to += 1
        grams, own, row = _grams(texts[at:to])
        letter_counts[at:to] = np.bincount(own, minlength=to - at)
        edge = np.searchsorted(row, np.arange(0, len(grams) + _BLOCK, _BLOCK))
        for b, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            part = grams[b * _BLOCK:(b + 1) * _BLOCK]
            letters, place = np.unique(part, return_inverse=True)
            base = np.stack([_letter(int(x), dims, seed) for x in letters])
            place = place.reshape(part.shape)
            bound = np.roll(base, 2, 1)[place[:, 0]] * np.roll(base, 1, 1)[place[:, 1]] * base[place[:, 2]]
            counts = np.bincount(own[lo:hi] * len(part) + row[lo:hi] - b * _BLOCK, minlength=(to - at) * len(part)).reshape(to - at, len(part))
            out[at:to] += counts.astype(np.float32) @ bound.astype(np.float32)
        at = to
    return out, letter_counts


def _size(letter_counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letter_counts, 1)).astype(np.int64), _SIZES - 1)


@dataclass(frozen=True)
class LanguageProfiles:
    """Prototypes by tag; ``of`` gives the tag and the cosine of texts in a frame."""
    tags: tuple[str, ...]
    prototypes: np.ndarray
    seed: int
    lengths: np.ndarray | None = None  # of the sums that the prototypes come from

    def guess(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        tags, scores = [], []
        for at in range(0, len(texts), _SLICE):
            v = bundles(texts[at:at + _SLICE], self.prototypes.shape[1], self.seed).astype(np.float64)
            length = np.sqrt((v * v).sum(1))
            if not self.tags:
                tags += [UNKNOWN] * len(v)
                scores.append(np.zeros(len(v)))
                continue
            cos = v @ self.prototypes.T / np.maximum(length, 1e-9)[:, None]
            best = cos.argmax(1)
            score = np.clip(cos[np.arange(len(cos)), best], 0.0, 1.0)
            tags += [self.tags[b] if n > 0 else UNKNOWN for b, n in zip(best, length, strict=True)]
            scores.append(np.where(length > 0, score, 0.0))
        return tags, np.concatenate(scores) if scores else np.zeros(0)

    def of(self, text: Column) -> Column:
        """A struct (``o_type``, ``score``) for a text column."""
        @F.pandas_udf("o_type string, score double")
        def tagged(column: pd.Series) -> pd.DataFrame:
            tags, score = self.guess(["" if t is None else t for t in column])
            return pd.DataFrame({"o_type": tags, "score": score})
        return tagged(text)

    def least_cosines(self, tagged: DataFrame, low: float = LOW) -> np.ndarray:
        """By tag and size (power of two of the letters), what a text must have in common with the language.

        ``tagged`` is what the profiles were learned from. The bound is the ``low`` quantile of the cosines of all texts of that tag and size with the
        rest of their language, from below; with fewer than 1 / ``low`` of them, the least. A size that the tag does not have takes the
        bound of the next smaller one, and no bound is below 1.5 / sqrt(dimensions), as unrelated vectors differ from 0 by 1 / sqrt(dimensions).
        """
        sums = self.prototypes * self.lengths[:, None]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(self.tags), _SIZES, _STEPS + 1), np.int64)
            for batch in batches:
                tags, texts = np.array(batch.column("o_type").to_pylist(), object), batch.column("o").to_pylist()
                for t, tag in enumerate(self.tags):
                    own = [texts[i] for i in np.flatnonzero(tags == tag)]
                    for at in range(0, len(own), _SLICE):
                        v, letter_counts = _bundles(own[at:at + _SLICE], sums.shape[1], self.seed)
                        v = v[letter_counts > 0].astype(np.float64)
                        rest = sums[t] - v
                        cos = (v * rest).sum(1) / np.maximum(np.sqrt((v * v).sum(1) * (rest * rest).sum(1)), 1e-9)
                        np.add.at(found[t], (_size(letter_counts[letter_counts > 0]), (np.clip(cos, 0, 1) * _STEPS).astype(np.int64)), 1)
            at = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in at), pa.array(found[at])], names=["t", "size", "cos", "n"])

        rows = _tagged(tagged).mapInArrow(count, "t int, size int, cos int, n long").groupBy("t", "size", "cos").agg(F.sum("n").alias("n")).collect()
        found = np.zeros((len(self.tags), _SIZES, _STEPS + 1), np.int64)
        for r in rows:
            found[r.t, r.size, r.cos] = r.n
        out = np.full((len(self.tags), _SIZES), 1.5 / sums.shape[1] ** 0.5)
        for t in range(len(self.tags)):
            for size in range(_SIZES):
                n = np.cumsum(found[t, size])
                bound = np.searchsorted(n, int(low * n[-1]), "right") / _STEPS if n[-1] else out[t, max(size - 1, 0)]
                out[t, size] = max(out[t, size], bound)
        return out

    def resembles(self, text: Column, least: np.ndarray) -> Column:
        """Whether a text has letters and reaches the bound of any language (see :meth:`least_cosines`)."""
        @F.pandas_udf("boolean")
        def enough(column: pd.Series) -> pd.Series:
            out = [np.zeros(0, bool)]
            for at in range(0, len(column), _SLICE):
                v, letter_counts = _bundles(["" if t is None else t for t in column[at:at + _SLICE]], self.prototypes.shape[1], self.seed)
                v = v.astype(np.float64)
                cos = v @ self.prototypes.T / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]
                out.append((cos >= least[:, _size(letter_counts)].T).any(1) & (letter_counts > 0))
            return pd.Series(np.concatenate(out))
        return enough(text)


def _tagged(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("o").cast("string").alias("o"), F.col("o_type").alias("o_type")).where("o is not null and o_type like '@%'")


def learn_languages(tagged: DataFrame, dims: int = DIMS, seed: int = 1) -> LanguageProfiles:
    """Prototypes from literals ``(o, o_type)`` whose type is a language tag such as ``@en``.

    Rows without a tag or text are passed over, repeated rows count again, and without any tagged row every later text is
    ``@und``. Each task sends one vector per tag it has met; only tags times ``dims`` sums come to the driver.
    """
    schema = pa.schema([("o_type", pa.string()), ("d", pa.int32()), ("v", pa.float64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            tags = np.array(batch.column("o_type").to_pylist(), object)
            texts = batch.column("o").to_pylist()
            for tag in sorted(set(tags)):
                own = [texts[i] for i in np.flatnonzero(tags == tag)]
                for at in range(0, len(own), _SLICE):
                    v = bundles(own[at:at + _SLICE], dims, seed).astype(np.float64).sum(0)
                    sums[tag] = sums.get(tag, 0) + v
        for tag, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([tag] * dims), pa.array(range(dims), pa.int32()), pa.array(v)], schema=schema)

    sums = _tagged(tagged).mapInArrow(partial, "o_type string, d int, v double").groupBy("o_type", "d").agg(F.sum("v").alias("v")).collect()
    tags = tuple(sorted({r.o_type for r in sums}))
    at = {t: i for i, t in enumerate(tags)}
    protos = np.zeros((len(tags), dims))
    for r in sums:
        protos[at[r.o_type], r.d] = r.v
    lengths = np.sqrt((protos ** 2).sum(1))
    return LanguageProfiles(tags, protos / np.maximum(lengths, 1e-9)[:, None], seed, lengths)


def tag_literals(literals: DataFrame, profiles: LanguageProfiles) -> DataFrame:
    """``s``, ``o_type`` (a learned tag; ``@und`` for NULL or a text without letters) and ``score`` (0 to 1) for each row.

    One pass without a shuffle. Equal texts get equal results; ties go to the first tag in order.
    """
    hit = profiles.of(F.col("o").cast("string"))
    return literals.select(F.col("s").alias("s"), hit.alias("t")).select("s", "t.o_type", "t.score")
