"""Lines that nearly repeat an earlier line, found by an exact set-similarity join.

A line is the set of its words. Two lines whose sets have a Jaccard similarity of at least t share a word among the first n - ceil(t n) + 1 of
each, in any order of words that all lines use; with rare words first such prefixes seldom meet by chance. Lines that share a prefix word are compared by
length, by position (what can still be shared after that word) and by the parity of hashed words, none of which loses a pair, and
what passes is counted on whole sets. A line goes if an earlier line is similar.

Rarity is counted over all words, in a table of 65,536 counters of hashed words; ties, and words that share a counter, are ordered by hash, so
the order is the same everywhere. Equal lines are settled where they meet. In the first round a line is held against its few
earliest candidates per word; lines with more candidates that none of these settles get all of theirs in a second round.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm import words as W
from tripleframe.llm.packed import bucket_count, pack, unpack
from tripleframe.llm.rows import keyed, texts
from tripleframe.llm.rows import literals as as_literals
from tripleframe.plans.support import cut_lineage

COUNTERS = 1 << 16
EARLIEST = 8
BROADCAST_BYTES = 8 << 20
PIECE_BYTES = 2 << 20  # of text that is cut into words at once
_SMALL = 512
_BLOCK = 64  # lines that are held against a large group at once
_STRETCHES = 9  # of parity, at most; more have so few bits each that lines meet oftener than without
_LONG = 64  # lines of more words send 256 bits of parity instead of 64
_PACKED = "b int, docs binary, counts binary, pos binary, value binary, n binary, i binary, parity binary, sign binary, wide binary, ask binary, known_docs binary, known_counts binary, known_pos binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]


class Lines(NamedTuple):
    """Sets of words of the lines that have any; line j has words ``first[j]`` to ``first[j + 1]`` of ``hashes``."""
    hashes: np.ndarray
    first: np.ndarray
    text: np.ndarray
    number: np.ndarray  # of the line in its text


def _order(h: np.ndarray, line: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """The order by line, rarity and hash. Sorted as one number where that tells all words of a line apart, as it does but for rare batches."""
    weight = np.zeros(len(h), np.int64) if counts is None else counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    first = int(line[0])
    if line[-1] - first < 1 << 20:
        key = (line - first).astype(np.uint64) << np.uint64(44) | weight.astype(np.uint64) << np.uint64(28) | h >> np.uint64(36)
        order = np.argsort(key)
        sorted_key, sorted_h = key[order], h[order]
        if not ((sorted_key[1:] == sorted_key[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return order
    return np.lexsort((h, weight, line))


def line_sets(os: list[bytes], counts: np.ndarray | None = None, only: np.ndarray | None = None) -> Lines:
    """Words in lower case (A to Z), rare ones first if ``counts`` (below 2^16) are given, else by hash; all lines, or those with a word of ``only`` (rising)."""
    b = W.batch([o.lower() for o in os])
    if not len(b.hashes):
        return Lines(b.hashes, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    breaks = np.cumsum(np.frombuffer(b.data, np.uint8) == 10, dtype=np.int64)
    line, text = breaks[b.starts], b.text
    if only is not None:
        mask = np.zeros(1 << 20, bool)
        mask[only & np.uint64((1 << 20) - 1)] = True
        near = np.flatnonzero(mask[b.hashes & np.uint64((1 << 20) - 1)])
        near = near[np.isin(b.hashes[near], only)]
        with_one = np.zeros(int(breaks[-1]) + 1, bool)
        with_one[line[near]] = True
        keep = with_one[line]
        b, line, text = b._replace(hashes=b.hashes[keep]), line[keep], text[keep]
        if not len(line):
            return Lines(b.hashes, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = _order(b.hashes, line, counts)
    h, line, text = b.hashes[order], line[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line, text = h[new], line[new], text[new]
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    head = np.zeros(len(os), np.int64)
    np.cumsum([o.count(b"\n") + 1 for o in os[:-1]], out=head[1:])
    return Lines(h, np.append(begin, len(h)), text[begin], line[begin] - head[text[begin]])


def word_counts(base: DataFrame) -> np.ndarray:
    """How many words of all texts fall on each counter. A task sends its sums in pieces, which are added up piece by piece."""
    piece = 1024

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, os, _ in texts(batches, PIECE_BYTES):
            h = W.words(b"\n".join(os).lower()).hashes
            total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTERS // piece), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, piece)])], names=["p", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": rows["p"][:1], "v": [sum(np.frombuffer(v, np.int64) for v in rows["v"]).tobytes()]})

    sums = base.select("k", "o").mapInArrow(count, "p int, v binary").groupBy("p").applyInPandas(add, "p int, v binary").collect()
    out = np.zeros((COUNTERS // piece, piece), np.int64)
    for r in sums:
        out[r.p] = np.frombuffer(r.v, np.int64)
    return out.ravel()


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _flat(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _asked_words(counts: np.ndarray, percent: int):
    """Prefix words of the asked lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, os, rows in texts(batches, PIECE_BYTES):
            asked = [b"\n".join(parts[j] for j in want) for parts, want in ((o.split(b"\n"), w) for o, w in zip(os, rows.column("ask").to_pylist(), strict=True))]
            x = line_sets(asked, counts)
            size = np.diff(x.first)
            take = size - _least(size, percent) + 1
            at = np.repeat(x.first[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(x.hashes[at]).view(np.int64))], names=["w"])
    return run


def _prefixes(counts: np.ndarray, percent: int, buckets: int, only: np.ndarray | None = None):
    """Packed prefix words of lines, the first of equal lines in a batch, a row per bucket; and the lines known to go.

    With a column ``ask``, only its lines look for partners, and only they are known to go.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, rows in texts(batches, PIECE_BYTES):
            order = np.argsort(np.array(ks, np.int64), kind="stable")
            ks = np.array(ks, np.int64)[order]
            x = line_sets([os[i] for i in order], counts, only)
            if not len(x.text):
                continue
            size = np.diff(x.first)
            sign = [np.add.reduceat(W.mix(x.hashes ^ np.uint64(c)), x.first[:-1]) for c in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A99)]
            by = np.lexsort((np.arange(len(size)), sign[1], sign[0]))
            again = np.zeros(len(size), bool)
            again[by[1:]] = (sign[0][by[1:]] == sign[0][by[:-1]]) & (sign[1][by[1:]] == sign[1][by[:-1]])
            ask = np.ones(len(size), bool)
            if "ask" in rows.schema.names:
                lists = rows.column("ask").to_pylist()
                wanted = [set(lists[i] or ()) for i in order]
                ask = np.array([n in wanted[t] for t, n in zip(x.text.tolist(), x.number.tolist(), strict=True)])
            bit, part = np.uint64(1) << (x.hashes >> np.uint64(58)), (x.hashes >> np.uint64(56)) & np.uint64(3)
            parity = np.bitwise_xor.reduceat(bit, x.first[:-1])
            wide = np.stack([np.bitwise_xor.reduceat(np.where(part == c, bit, np.uint64(0)), x.first[:-1]) for c in range(3)], 1)
            take = size - _least(size, percent) + 1
            take[again] = 0
            line = np.repeat(np.arange(len(size)), take)
            i = np.arange(len(line)) - np.repeat(np.cumsum(take) - take, take)
            h = x.hashes[x.first[line] + i]
            if only is not None:
                keep = np.isin(h, only)
                line, i, h = line[keep], i[keep], h[keep]
            if not len(h):
                continue
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            line, i, h, bucket = line[order], i[order], h[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            known = pack(x.text[again & ask], x.number[again & ask], ks)
            out = []
            for b in np.flatnonzero(np.diff(edge)):
                s = slice(edge[b], edge[b + 1])
                at = line[s]
                out.append((int(b), *pack(x.text[at], x.number[at], ks), (h[s] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _planes(size[at]), _planes(i[s]),
                            parity[at].tobytes(), sign[0][at].tobytes(), wide[at[size[at] > _LONG]].tobytes(), np.packbits(ask[at]).tobytes(), *known))
                known = (b"",) * 3
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)
    return run


def _length_classes(percent: int, top: int) -> list[tuple[int, int]]:
    """Classes of lengths, from the first to below the second; similar lines are in one or in two next to each other."""
    low, out = 1, []
    while low <= top:
        high = max(low + 1, -(-low * 130 // 100), -(-low * 105 // percent))
        out.append((low, high))
        low = high
    return out


def _pairs(percent: int, most: int | None):
    """Candidate pairs of a bucket: a line (``k``, ``line``), an earlier one (``k2``, ``line2``), and whether the line may have ``more``. Without a second line: goes."""
    def run(rows: pa.Table) -> pa.Table:
        parts, known = [], []
        for r in rows.to_pylist():
            keys, line = unpack(r["docs"], r["counts"], r["pos"])
            parts.append((np.frombuffer(r["value"], np.uint32), keys, line, _flat(r["n"]), _flat(r["i"]), np.frombuffer(r["parity"], np.uint64),
                          np.frombuffer(r["sign"], np.uint64), np.unpackbits(np.frombuffer(r["ask"], np.uint8), count=len(keys)).astype(bool)))
            if r["known_docs"]:
                known.append(unpack(r["known_docs"], r["known_counts"], r["known_pos"]))
        wide = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(-1, 3)
        value, keys, line, n, i, parity, sign, ask = (np.concatenate(c) for c in zip(*parts, strict=True))
        row = np.cumsum(n > _LONG) - 1
        time = np.empty(len(n), np.int64)
        time[np.lexsort((line, keys))] = np.arange(len(n))  # the order of the lines
        order = np.lexsort((time, n, value))
        value, keys, line, n, i, parity, sign, ask, row, time = (c[order] for c in (value, keys, line, n, i, parity, sign, ask, row, time))
        same = lambda q, p: (sign[q] == sign[p]) & (parity[q] == parity[p]) & (n[q] == n[p])

        sums = np.arange(2 * int(n.max(initial=0)) + 1)
        needs = (percent * sums + 99 + percent) // (100 + percent)
        aparts = (sums - 2 * needs).astype(np.int16)  # in how many words two lines may differ, by the sum of their sizes

        def passes(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs that may be similar, of those whose parities allow it: by what can be shared from here on, and by wider parities."""
            both = n[q] + n[p]
            good = np.minimum(n[q] - i[q], n[p] - i[p]) >= needs[both]
            q, p, most_apart = q[good], p[good], aparts[both[good]]
            two = np.flatnonzero((n[q] > _LONG) & (n[p] > _LONG))
            if len(two):
                a, b = wide[row[q[two]]], wide[row[p[two]]]
                last = parity[q[two]] ^ parity[p[two]] ^ np.bitwise_xor.reduce(a ^ b, 1)
                good = np.ones(len(q), bool)
                good[two] = np.bitwise_count(a ^ b).sum(1) + np.bitwise_count(last) <= most_apart[two]
                q, p = q[good], p[good]
            return q, p

        begin = np.flatnonzero(np.diff(value.astype(np.int64), prepend=-1))
        size = np.diff(np.append(begin, len(value)))
        per = np.repeat(size, size)
        qs, ps = [], []
        place = np.zeros(len(value), np.int64)

        def meet(at: np.ndarray, group: np.ndarray) -> None:
            """Holds lines ``at`` (in order of group and length) against those of their group; groups are small."""
            start = np.flatnonzero(np.diff(group, prepend=-1))
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            sizes, bits = n[at], parity[at]
            least = _least(sizes, percent)
            live, d = np.flatnonzero(rank > 0), 1
            while len(live):
                live = live[rank[live] >= d]
                live = live[sizes[live - d] >= least[live]]
                other = live - d
                near = np.bitwise_count(bits[live] ^ bits[other]) <= aparts[sizes[live] + sizes[other]]
                a, b = at[live[near]], at[other[near]]
                later, earlier = np.where(time[a] > time[b], a, b), np.where(time[a] > time[b], b, a)
                q, p = passes(later[ask[later]], earlier[ask[later]])
                qs.append(q)
                ps.append(p)
                d += 1

        def meet_in_time(own: np.ndarray) -> None:
            """From the earliest on, lines of a large group are held, block by block, against those that still look for partners."""
            own = own[np.argsort(time[own], kind="stable")]
            done, found, bits = ~ask[own], np.zeros(len(own), np.int64), parity[own]
            bound = aparts[2 * n[own].max()]
            for at in range(0, len(own), _BLOCK):
                later = np.flatnonzero(~done[at + 1:]) + at + 1
                if not len(later):
                    break
                y, x = np.divmod(np.flatnonzero(np.bitwise_count(bits[later][:, None] ^ bits[at:at + _BLOCK]) <= bound), min(_BLOCK, len(own) - at))
                y, x = later[y], x + at
                q, p = own[y], own[x]
                near = (y > x) & (np.bitwise_count(parity[q] ^ parity[p]) <= aparts[n[q] + n[p]])
                q, p = passes(q[near], p[near])
                qs.append(q)
                ps.append(p)
                place[own] = np.arange(len(own))
                hit = place[q]
                np.add.at(found, hit, 1)
                done[hit[same(q, p)]] = True
                if most is not None:
                    done |= found > most
                done[:at + _BLOCK] = True  # they have met all earlier ones

        small = np.flatnonzero(per <= _SMALL)
        meet(small, np.repeat(np.arange(len(begin)), size)[small])
        # Lines with a word that many have must also have one of several stretches of parity bits in common: they differ in fewer words than there
        # are stretches. How many that takes depends on a class of lengths; a line looks in its own class and in the next.
        many = np.flatnonzero(per > _SMALL)
        for low, high in _length_classes(percent, int(n[many].max(initial=0))):
            mine = many[(n[many] < high) & (100 * n[many] >= percent * low)]
            apart = 2 * (high - 1) * (100 - percent) // (100 + percent)
            if not len(mine) or apart > _STRETCHES:
                groups = [(mine, value[mine].astype(np.int64))]
            else:
                edge = (np.arange(apart + 2) * 64) // (apart + 1)
                groups = [(mine, W.mix((parity[mine] >> np.uint64(x) & np.uint64((1 << y - x) - 1)) ^ W.mix(value[mine].astype(np.uint64) + np.uint64(x << 32))).view(np.int64))
                          for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)] if apart else [(mine, W.mix(parity[mine] ^ W.mix(value[mine].astype(np.uint64))).view(np.int64))]
            for at, key in groups:
                order = np.argsort(key, kind="stable")  # length stays in order within a group
                at, key = at[order], key[order]
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                length = np.diff(np.append(start, len(key)))
                number, of = np.repeat(np.arange(len(start)), length), np.repeat(length, length)
                few = of <= _SMALL
                meet(at[few], number[few])
                for x, y in zip(start[length > _SMALL], length[length > _SMALL], strict=True):
                    meet_in_time(at[x:x + y])
        q, p = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (qs, ps))
        pair = np.sort(q * len(value) + p)
        q, p = np.divmod(pair[np.diff(pair, prepend=-1) > 0], max(len(value), 1))  # a pair may have met more than once
        settled = np.unique(q[same(q, p)])  # equal sets, by 64 bits of a sum of hashes, parity and size; they meet at every word and are told of once
        told = settled[i[settled] == 0]
        known.append((keys[told], line[told]))
        open_ = ~np.isin(q, settled)
        q, p = q[open_], p[open_]
        order = np.lexsort((time[p], q))
        q, p = q[order], p[order]
        more = np.zeros(len(q), bool)
        if most is not None and len(q):
            start = np.flatnonzero(np.diff(q, prepend=-1))
            per = np.diff(np.append(start, len(q)))
            more = np.repeat(per, per) > most
            first = np.arange(len(q)) - np.repeat(start, per) < most
            q, p, more = q[first], p[first], more[first]
        out = [pa.array(keys[q]), pa.array(line[q]), pa.array(keys[p]), pa.array(line[p]), pa.array(more)]
        tables = [pa.Table.from_arrays(out, names=["k", "line", "k2", "line2", "more"])]
        for ks, ls in known:
            none = pa.nulls(len(ks), pa.int64())
            tables.append(pa.Table.from_arrays([pa.array(ks), pa.array(ls), none, none, pa.array(np.zeros(len(ks), bool))], names=["k", "line", "k2", "line2", "more"]))
        return pa.concat_tables(tables)
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the asked lines."""
    for ks, os, rows in texts(batches, PIECE_BYTES):
        lists = rows.column("lines").to_pylist()
        asked = [b"\n".join(parts[j] for j in want) for parts, want in ((o.split(b"\n"), w) for o, w in zip(os, lists, strict=True))]
        x = line_sets(asked)
        body = [x.hashes[a:b].tobytes() for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ks, np.int64)[x.text]), pa.array([lists[t][j] for t, j in zip(x.text, x.number, strict=True)], pa.int64()),
                                          pa.array(body, pa.binary())], names=["k", "line", "words"])


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True):
                if a == b:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("k").filter(keep), batch.column("line").filter(keep)], names=["k", "line"])
    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, os, rows in texts(batches, PIECE_BYTES):
        lists = rows.column("gone").to_pylist()
        out, count = [], []
        for o, gone in zip(os, lists, strict=True):
            parts = o.split(b"\n")
            count.append(sum(1 for x in parts if x.strip(b" \t\n\r\x0b\x0c")))
            if gone:
                bad = set(gone)
                o = b"\n".join(x for j, x in enumerate(parts) if j not in bad)
            out.append(o)
        yield pa.RecordBatch.from_arrays([rows.column("s"), pa.array(count, pa.int64()), pa.array([len(g or ()) for g in lists], pa.int64()), pa.array(out, pa.binary()).cast(pa.string()),
                                          pa.array([sorted(g or ()) for g in lists], pa.list_(pa.int64()))], names=["s", "n_lines", "n_removed", "o", "removed"])


def without_lines(text: Column, gone: Column) -> Column:
    """A text without the lines whose numbers (from 0) are in ``gone``; as it is where that is NULL."""
    def kept(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(parts, i.cast("int"))), "\n")

    cut = F.transform(F.array(F.split(text, "\n", -1)), kept)  # in an array of one, so that a text is split once and not for every line
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.get(cut, F.lit(0)))


def _small(lists: DataFrame, name: str) -> DataFrame:
    """Lists of lines by key, in a checkpoint; to be broadcast only if a count of them shows that they take few bytes."""
    lists = cut_lineage(lists)
    rows, items = lists.agg(F.count(F.lit(1)), F.sum(F.size(name))).first()
    return F.broadcast(lists) if 32 * rows + 8 * (items or 0) <= BROADCAST_BYTES else lists


def repeated_lines(base: DataFrame, percent: int) -> DataFrame:
    """``k`` and ``line`` of every line of numbered literals that an earlier line resembles; no two literals may share a key."""
    counts = np.unique(word_counts(base), return_inverse=True)[1].ravel()  # only their order matters; as ranks they are below 2^16
    buckets = bucket_count((base.agg(F.sum(F.length("o"))).first()[0] or 0) // 4)
    schema = "k long, line long, k2 long, line2 long, more boolean"

    def similar(pairs: DataFrame) -> DataFrame:
        """Lines of pairs that are similar, and lines without a second one, which go."""
        known = pairs.where("k2 is null").select("k", "line")
        pairs = pairs.where("k2 is not null").select("k", "line", "k2", "line2")
        ends = pairs.select(F.explode(F.array(F.struct("k", "line"), F.struct(F.col("k2").alias("k"), F.col("line2").alias("line")))).alias("e")).select("e.*").distinct()
        need = ends.groupBy("k").agg(F.sort_array(F.collect_list("line")).alias("lines"))
        sets = cut_lineage(base.join(_small(need, "lines"), "k").select("k", "o", "lines").mapInArrow(_sets, "k long, line long, words binary").dropDuplicates(["k", "line"]))
        other = sets.select(F.col("k").alias("k2"), F.col("line").alias("line2"), F.col("words").alias("wb"))
        both = pairs.join(sets.withColumnRenamed("words", "wa"), ["k", "line"]).join(other, ["k2", "line2"])
        return cut_lineage(both.select("k", "line", "wa", "wb").mapInArrow(_similar(percent), "k long, line long").distinct()).unionByName(known)

    entries = base.select("k", "o").mapInArrow(_prefixes(counts, percent, buckets), _PACKED)
    found = cut_lineage(entries.groupBy("b").applyInArrow(_pairs(percent, EARLIEST), schema).groupBy("k", "line", "k2", "line2").agg(F.max("more").alias("more")))
    gone = similar(found)
    rest = cut_lineage(found.where("more").select("k", "line").distinct().join(gone, ["k", "line"], "left_anti").groupBy("k").agg(F.collect_list("line").alias("ask")))
    if rest.limit(1).count():
        small, only = _small(rest, "ask"), None
        words = cut_lineage(base.join(small, "k").select("o", "ask", "k").mapInArrow(_asked_words(counts, percent), "w long").distinct())
        if words.count() <= BROADCAST_BYTES // 8:  # else every line is sent again
            only = np.sort(np.array([r.w for r in words.collect()], np.int64).view(np.uint64))
        asked = base.join(small, "k", "left").select("k", "o", "ask").mapInArrow(_prefixes(counts, percent, buckets, only), _PACKED)
        found = cut_lineage(asked.groupBy("b").applyInArrow(_pairs(percent, None), schema).select("k", "line", "k2", "line2").distinct())
        gone = gone.unionByName(similar(found))
    return gone.distinct()


def drop_repeated_lines(literals: DataFrame, percent: int = 80) -> DataFrame:
    """``s``, ``n_lines`` (with words), ``n_removed``, the kept lines as ``o``, and ``removed`` (their numbers from 0), for every row.

    Lines end at U+000A. A line goes if an earlier one (smaller ``s``, or above it) has 100 * shared words >= ``percent`` * words of either, case of A to Z and repeats aside,
    whether or not that one goes too. Lines without words stay. A NULL text has no lines. NULL subjects come first; rows that repeat subject and
    text are one literal and all get its result; other literals of one subject are ordered by a hash of their text.
    """
    base, _, unique = keyed(as_literals(literals), "s", "o")
    kind = base.schema["s"].dataType.simpleString()
    gone = repeated_lines(base if unique else base.dropDuplicates(["k"]), percent).groupBy("k").agg(F.collect_list("line").alias("gone"))
    return base.join(gone, "k", "left").select("s", "o", "k", "gone").mapInArrow(
        _kept, f"s {kind}, n_lines long, n_removed long, o string, removed array<long>")
