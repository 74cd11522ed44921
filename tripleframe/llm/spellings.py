"""Spelling variants of the words in a graph's literals: words one letter apart, the rare one pointing to the frequent one.

PartEnum. A word is a multiset of letters, a binary vector with a place for each letter and each of its repeats. A replaced letter changes at most
two places, an inserted or deleted one a single place. The places are dealt to a few parts by hash; whichever parts a change falls in, the
places in all others stay, so a signature for every choice of parts to leave out gives two near words one in common: two of four parts for words of the
same length, one of two for words whose lengths differ by one. One edit also leaves the front or the back half of a word as it is, so a
signature is refined by either half; without that, words made of the same letters would meet in large groups. Words meet by equal signatures in a
join, and every pair is then compared letter by letter.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import words as W
from tripleframe.plans.support import cut_lineage

PARTS, CROSS_PARTS = 4, 2
SAME, SHORT, LONG = 0, 1, 2  # signatures for words of the same length, and for those of one letter more or less
# A word is a run of Latin letters, with accents as in U+00C0 to U+00FF; only A to Z have a lower case here.
LETTERS = "a-z\\u00C0-\\u00FF"
_SOLID = bytes.maketrans(b" \t\n\x0b\x0c\r", bytes(range(6)))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SALT = 0x9E6C63D0876A9A99


def literal_words(triples: DataFrame, least_letters: int = 7, misspell: int | None = None) -> DataFrame:
    """``word`` and ``n``: how often each word of at least ``least_letters`` letters occurs in the literals of ``triples``.

    Takes triples (``s``, ``o``, ``o_kind``; further columns are passed over) or only ``s`` and ``o``. Objects that are IRIs are left out. Words are maximal runs of A to Z,
    a to z and U+00C0 to U+00FF in the whole text, with A to Z lower-cased. NULL and empty literals have none; rows that repeat count again.

    ``misspell`` makes misspellings to try out :func:`word_variants` with: if it divides the CRC-32 c of ``<s>:<word>``, the word's letter number
    c % length (from 0) is left out; what is left must have ``least_letters`` still. A NULL ``s`` is an empty one there.
    """
    rows = triples.where(F.col("o_kind") == "lit") if "o_kind" in triples.columns else triples
    text = F.translate(F.col("o").cast("string"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    out = rows.where(F.col("o").isNotNull()).select(F.coalesce(F.col("s").cast("string"), F.lit("")).alias("s"), F.explode(runs).alias("word"))
    if misspell is not None:
        check = F.crc32(F.concat("s", F.lit(":"), "word").cast("binary"))
        at = (F.col("check") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        out = out.withColumn("check", check).select(F.when(F.col("check") % misspell == 0, cut).otherwise(F.col("word")).alias("word"))
        out = out.where(F.length("word") >= least_letters)
    return out.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _halves(ws: list[str], size: np.ndarray) -> list[np.ndarray]:
    """Hashes of the front and the back of each word, as if it had ``size`` letters."""
    front = [w[:n // 2] for w, n in zip(ws, size.tolist(), strict=True)]
    back = [w[len(w) - (n - n // 2):] for w, n in zip(ws, size.tolist(), strict=True)]
    # A letter in front keeps empty halves from vanishing; white space, where a word has any, must not cut it.
    return [W.batch([f"x{x}".encode().translate(_SOLID) for x in side]).hashes for side in (front, back)]


def signatures(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures, a row for each word, and the kind of each column.

    Words that one replaced letter makes equal have a SAME signature in common; of words that one inserted letter makes equal the shorter has a SHORT one that is
    a LONG one of the longer.
    """
    size = np.array([len(w) for w in ws], np.int64)
    flat = np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(ws)), size)
    order = np.lexsort((flat, own))
    letter = flat[order]
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (own[1:] != own[:-1])
    start = np.flatnonzero(new)
    repeat = np.arange(len(letter)) - np.repeat(start, np.diff(np.append(start, len(letter))))
    place = W.mix(letter * np.uint64(0x9E3779B97F4A7C15) + repeat.astype(np.uint64))
    value, out, kinds = W.mix(place ^ np.uint64(_SALT)), [], []
    own_halves, less_halves = _halves(ws, size), _halves(ws, size - 1)

    def add(kind: int, parts: int, left_out: int, base: np.ndarray, halves: list[np.ndarray]) -> None:
        sums = np.zeros((len(ws), parts), np.uint64)
        np.add.at(sums, (own, ((place >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)), value)
        for c, gone in enumerate(combinations(range(parts), left_out)):
            kept = sums[:, [x for x in range(parts) if x not in gone]].sum(1, dtype=np.uint64)
            for side, half in enumerate(halves):
                mark = W.mix((base * 64 + (4 * c + 2 * side + (kind != SAME))).astype(np.uint64))
                out.append(W.mix(W.mix(kept ^ mark) ^ half))
                kinds.append(kind)

    add(SAME, PARTS, 2, size, own_halves)
    add(SHORT, CROSS_PARTS, 1, size, own_halves)
    add(LONG, CROSS_PARTS, 1, size - 1, less_halves)
    return np.stack(out, 1), np.array(kinds, np.int8)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys, kinds = signatures(batch.column("word").to_pylist())
            rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), keys.shape[1])))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(kinds, len(batch))), *rows.columns], names=["sig", "kind", "word", "n"])


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``other`` and ``other_n``: every word with each one that differs by exactly one inserted, deleted or replaced letter, both ways."""
    sides = words.select("word", "n").mapInArrow(_signed, "sig long, kind byte, word string, n long")
    # The kinds are compared in one number: conditions on one side alone would make the sides differ, and both would be shuffled.
    both = "x.kind * 3 + y.kind"
    fit = F.expr(f"x.sig = y.sig and ({both} = {4 * SAME} and x.word < y.word or {both} = {3 * SHORT + LONG}) and levenshtein(x.word, y.word, 1) = 1")
    pairs = sides.alias("x").join(sides.alias("y"), fit).select("x.word", "x.n", F.col("y.word").alias("other"), F.col("y.n").alias("other_n"))
    pairs = cut_lineage(pairs.distinct())
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def word_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for every word of a frame of distinct ``word`` and its count ``n``.

    ``n_near`` counts the words that differ from it by one letter. ``form`` is the most frequent of them (of equally frequent ones the smallest in the order of code
    points) and ``form_n`` its count, if that is at least ``factor`` times ``n``; else both are NULL. ``root`` is where forms lead to from ``word``, the word
    itself if it has none. Frequencies rise by ``factor`` with every step, so few rounds of joins follow any chain. Further columns are passed over;
    a NULL word or count takes no part; no words, no rows.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    words = cut_lineage(words.select("word", "n").where("word is not null and n is not null"))
    # The smallest word of the largest count is the least of (-count, word).
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    fit = -F.col("b.m") >= factor * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                   F.when(fit, F.col("b.w")).alias("form"), F.when(fit, -F.col("b.m")).alias("form_n"))
    out = cut_lineage(out)
    step = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").limit(1).count() == 0:
            break
        step = step.drop("moved")
    return out.join(step.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(triples: DataFrame, least_letters: int = 7, least_n: int = 2, factor: int = 10, misspell: int | None = None) -> DataFrame:
    """:func:`word_variants` of the words that the literals of ``triples`` have at least ``least_n`` times (see :func:`literal_words`)."""
    return word_variants(literal_words(triples, least_letters, misspell).where(F.col("n") >= least_n), factor)
