"""Literals that repeat benchmark items, also with other numbers, names or units.

Both sides are turned into templates: words in lower case without their punctuation, with placeholders for numbers, for a unit
right after a number, and for names (capitalised words inside a sentence). Windows of template words are joined by hash; windows of
placeholders mostly, and those that only one side has placeholders in, are joined by the words themselves (in lower case, with the signs between them). Windows
that lie on one diagonal (same distance between text and item) are then checked for slots: a value that fills an item's placeholders stands
for the value of the text that it meets most often, and windows in which it meets another are left out, all of them if two values are as
frequent: such questions only look alike. A text leaks an item if enough of the item's windows are left.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripleframe.llm import words as W
from tripleframe.llm.rows import numbered, texts
from tripleframe.plans.support import cut_lineage

WINDOW = 8
SHARE = 0.5
RUN = 20  # words in a row that are a leak whatever their share of the item
PLAIN = 4  # words of a window that must not be placeholders (half of a shorter one), or it is joined by its words
LOCAL_WINDOWS = 2_000_000  # up to this many hashes of benchmark windows (20 bytes each) are sent to every task; beyond, both sides are shuffled

# Units that count as such after a number.
UNITS = frozenset("""mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram
grams kilogram kilograms ton tons pound pounds ml l liter liters litre litres ms s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years cent cents dollar dollars usd euro euros eur percent km/h mph kmh hz khz mhz ghz w kw kwh v a b kb mb gb tb c f k""".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(%|[a-z]{1,3})?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_NUM, _UNIT, _NAME = np.uint64(1), np.uint64(2), np.uint64(3)
_SIMPLE = np.zeros(256, bool)
_SIMPLE[97:123] = True


class Template(NamedTuple):
    """Template words of several texts; ``first`` as in :class:`words.Batch`, ``at`` says which word of the batch each is.

    ``plain`` has the words without placeholders, each with the signs (words of punctuation only) in front of it.
    """
    hashes: np.ndarray
    plain: np.ndarray
    slot: np.ndarray  # is a placeholder
    at: np.ndarray
    first: np.ndarray


def template(b: W.Batch) -> Template:
    n = len(b.hashes)
    if n == 0:
        return Template(b.hashes, b.hashes, np.zeros(0, bool), np.zeros(0, np.int64), b.first)
    buf = np.frombuffer(b.data, np.uint8)
    odd = np.concatenate([[0], np.cumsum(~_SIMPLE[buf])])
    odd = np.flatnonzero(odd[b.ends] > odd[b.starts])
    hashes, drop = b.hashes.copy(), np.zeros(n, bool)
    number, unit, title, stop = (np.zeros(n, bool) for _ in range(4))
    _, some, group = np.unique(b.hashes[odd], return_index=True, return_inverse=True)
    raw = [b.data[b.starts[i]:b.ends[i]].decode("utf-8", "replace") for i in odd[some]]
    bare = [_EDGE.sub("", w) for w in raw]
    low = ["".join(w.lower().split()) for w in bare]
    new = W.words("\n".join(w or "\x01" for w in low).encode()).hashes
    hashes[odd] = new[group]
    each = lambda f: np.array(f, bool)[group]
    drop[odd] = each([not w for w in low])
    number[odd] = each([_NUMBER.fullmatch(w) is not None for w in low])
    title[odd] = each([len(w) > 1 and w[0].isupper() and w[1:].islower() for w in bare])
    stop[odd] = each([w[-1] in ".!?:" for w in raw])
    small = {int(h) for h in W.words("\n".join(sorted(UNITS)).encode()).hashes}
    unit = np.isin(hashes, np.fromiter(small, np.uint64))
    plain = hashes.copy()
    start = np.zeros(n, bool)
    start[b.first[:-1][np.diff(b.first) > 0]] = True
    start[1:] |= stop[:-1] | (buf[b.starts[1:] - 1] == 10)
    after = np.concatenate([[False], number[:-1]]) & ~start
    hashes[number], hashes[unit & after], hashes[title & ~start & ~number] = _NUM, _UNIT, _NAME
    slot = number | (unit & after) | (title & ~start)
    keep = ~drop
    count = np.concatenate([[0], np.cumsum(keep)])
    kept, sign = np.flatnonzero(keep), np.flatnonzero(drop)
    sign = sign[count[sign] < count[b.first[np.searchsorted(b.first, sign, "right")]]]  # a sign belongs to the next word of its text
    to = kept[count[sign]]
    front = np.zeros(n, np.uint64)
    np.add.at(front, to, W.mix(b.hashes[sign] + (to - sign).astype(np.uint64)))
    plain[to] = W.mix(plain[to] * np.uint64(3) + front[to])
    return Template(hashes[keep], plain[keep], slot[keep], kept, count[b.first])


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in it of every window, and whether the hash is of the words themselves.

    Windows with enough plain words have a hash of their template, and all one of their words unless it is the same.
    """
    h = W.rolling(t.hashes, width, 0xA24BAED4963EE407)
    if not len(h):
        return h, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)
    exact = W.rolling(t.plain, width, 0xA24BAED4963EE407)
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    filled = np.concatenate([[0], np.cumsum(t.slot)])
    inside = text[:len(h)] == text[width - 1:]
    enough = width - (filled[width:] - filled[:-width]) >= min(PLAIN, (width + 1) // 2)
    i, j = np.flatnonzero(inside & enough), np.flatnonzero(inside & ~(enough & (h == exact)))
    at = np.concatenate([i, j])
    return np.concatenate([h[i], exact[j]]), text[at], at - t.first[text[at]], np.repeat([False, True], [len(i), len(j)])


def _slots(t: Template, text: int, at: int, width: int) -> np.ndarray:
    return np.flatnonzero(t.slot[t.first[text] + at:t.first[text] + at + width])


def _values(b: W.Batch, t: Template, text: int, at: int, width: int) -> tuple[str, ...]:
    i = t.first[text] + at + _slots(t, text, at, width)
    return tuple(_EDGE.sub("", b.data[b.starts[j]:b.ends[j]].decode("utf-8", "replace")).lower() for j in t.at[i])


def _index(bs: list[bytes], window: int) -> pd.DataFrame:
    """Windows of benchmark items: ``width``, ``hash`` (signed), ``item``, ``ipos``, ``slots`` (values) and ``places`` of them in the window, ``thin``
    (not enough plain words), and of the item ``total`` windows, ``plain`` ones that are not thin."""
    b = W.batch(bs)
    t = template(b)
    sizes = np.diff(t.first)
    out = []
    for width in sorted({min(window, int(n)) for n in sizes if n}):
        h, text, at, exact = windows(t, width)
        fit = np.minimum(sizes[text], window) == width
        h, text, at, exact = h[fit].view(np.int64), text[fit], at[fit], exact[fit]
        enough = set(zip(text[~exact].tolist(), at[~exact].tolist(), strict=True))
        out += [(width, int(x), int(i), int(p), _values(b, t, i, p, width), tuple(_slots(t, i, p, width).tolist()), (int(i), int(p)) not in enough) for x, i, p in zip(h, text, at, strict=True)]
    frame = pd.DataFrame(out, columns=["width", "hash", "item", "ipos", "slots", "places", "thin"])
    places = frame[["item", "ipos", "thin"]].drop_duplicates()
    if not len(frame):
        return frame.assign(total=0, plain=0)
    frame["total"] = frame["item"].map(places.groupby("item").size())
    frame["plain"] = frame["item"].map((~places["thin"].astype(bool)).groupby(places["item"]).sum())
    return frame


def _run(places: set[int]) -> int:
    """Most windows that follow each other."""
    best = n = 0
    for p in sorted(places):
        n = n + 1 if p - 1 in places else 1
        best = max(best, n)
    return best


def _decide(hits: list[tuple], share: float, run: int) -> list[tuple]:
    """Hits (item, ipos, dpos, item slots, text slots, places, thin, total, plain, width) of one text: rows (item, windows, total, same values) of what it leaks.

    Hits by the words themselves have no text slots: these are the item's.
    """
    lines: dict[tuple, list[tuple]] = {}
    for h in hits:
        lines.setdefault((h[0], h[2] - h[1]), []).append(h)
    found: dict = {}
    for (item, _), own in lines.items():
        met: dict[int, tuple[str, str]] = {}
        for h in own:
            met.update((h[1] + p, pair) for p, pair in zip(h[5], zip(h[3], h[4] or h[3], strict=True), strict=True))
        counts: dict[str, dict[str, int]] = {}
        for a, b in met.values():
            counts.setdefault(a, {}).setdefault(b, 0)
            counts[a][b] += 1
        means = {a: max(bs, key=bs.get) for a, bs in counts.items() if list(bs.values()).count(max(bs.values())) == 1}
        agree = [h for h in own if all(means.get(a) == b for a, b in zip(h[3], h[4] or h[3], strict=True))]
        seen, plain, _, _, same, long = found.setdefault(item, (set(), set(), own[0][7], own[0][8], set(), set()))
        in_a_row = {h[1] for h in agree} | {h[1] for h in own if h[3] == (h[4] or h[3])}  # the same words are a copy, whatever else the text says
        if _run(in_a_row) + own[0][9] - 1 >= run:
            long.update(in_a_row)
        seen.update(h[1] for h in agree)
        plain.update(h[1] for h in agree if not h[6])
        if agree or long:
            same.add(all(a == b for a, b in met.values()))
    return [(item, len(seen | long), total, any(same)) for item, (seen, plain, total, n, same, long) in found.items()
            if long or (seen and (len(seen) >= share * total or (plain and len(plain) >= share * n)))]


def leaks(literals: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, local_windows: int = LOCAL_WINDOWS, run: int = RUN) -> DataFrame:
    """``s``, ``item``, ``windows``, ``item_windows`` and ``same_values`` for every literal that leaks a benchmark item.

    ``benchmark`` has ``item`` and ``o``. An item leaks if ``share`` of its windows, or of those with enough plain words, are found, or windows
    in a row that span ``run`` words. An item shorter than ``window`` words is one window; one without words is never found. Windows that are nearly all placeholders are
    found with the same values only. NULL and empty texts leak nothing. Rows that repeat subject and text give one row per item; repeated
    items are found each by their own text, and NULL items are passed over. Windows of an item match anywhere in a text, however long.
    """
    lits = numbered(literals)
    found = leaked_items(lits, benchmark, window, share, local_windows, run)
    return lits.select("k", "s").distinct().join(found, "k").drop("k")


def leaked_items(lits: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, local_windows: int = LOCAL_WINDOWS, run: int = RUN) -> DataFrame:
    """The same by key ``k`` of numbered literals."""
    items = benchmark.select("item", F.coalesce(F.col("o").cast("string"), F.lit("")).alias("o")).where("item is not null")
    size = items.agg(F.sum(F.length("o"))).first()[0] or 0
    kind = benchmark.schema["item"].dataType.simpleString()
    out = f"k long, item {kind}, windows long, item_windows long, same_values boolean"
    if size <= local_windows:  # a window has two hashes at most and begins at a word, which takes two characters at least
        rows = [r for r in items.collect()]
        index = _index([r.o.encode() for r in rows], window).sort_values("hash", kind="stable", ignore_index=True)
        found = lits.select("k", "o").mapInArrow(_probe(index, [r.item for r in rows], share, run, to_arrow_type(benchmark.schema["item"].dataType)), out)
    else:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                f = _index([t.encode() for t in batch["o"]], window)
                at = f["item"].to_numpy(int)
                f["item"], f["row"] = batch["item"].to_numpy()[at], batch["row"].to_numpy()[at]
                f["slots"], f["places"] = f["slots"].map(list), f["places"].map(list)
                yield f
        index = cut_lineage(items.withColumn("row", F.xxhash64("o")).mapInPandas(cut, f"width int, hash long, item {kind}, row long, ipos long, slots array<string>, places array<int>, thin boolean, total long, plain long"))
        widths = [r.width for r in index.select("width").distinct().collect()]
        hits = lits.select("k", "o").mapInArrow(_windows_of(widths), "k long, width int, hash long, dpos long, dslots array<string>").join(index, ["width", "hash"])

        def decide(rows: pd.DataFrame) -> pd.DataFrame:
            hits = list(zip(zip(rows["item"], rows["row"], strict=True), rows["ipos"], rows["dpos"], *(map(tuple, rows[c]) for c in ("slots", "dslots", "places")), *(rows[c] for c in ("thin", "total", "plain", "width")), strict=True))
            return pd.DataFrame([(rows["k"].iloc[0], r[0][0], *r[1:]) for r in _decide(hits, share, run)], columns=["k", "item", "windows", "item_windows", "same_values"])
        found = hits.groupBy("k").applyInPandas(decide, out)
    return found.distinct()


def _probe(index: pd.DataFrame, names: list, share: float, least: int, kind: pa.DataType):
    by_width = [(int(w), f["hash"].to_numpy(np.int64), f) for w, f in index.groupby("width")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for ks, os, _ in texts(batches):
            b = W.batch(os)
            t = template(b)
            hits: dict[int, list[tuple]] = {}
            for width, keys, f in by_width:
                h, text, at, exact = windows(t, width)
                h = h.view(np.int64)
                low = np.searchsorted(keys, h)
                for j in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == h):
                    mine = () if exact[j] else _values(b, t, text[j], at[j], width)
                    m = low[j]
                    while m < len(keys) and keys[m] == h[j]:
                        hits.setdefault(int(text[j]), []).append((f["item"].iat[m], f["ipos"].iat[m], int(at[j]), f["slots"].iat[m], mine, *(f[c].iat[m] for c in ("places", "thin", "total", "plain")), width))
                        m += 1
            out += [(ks[i], names[r[0]], *r[1:]) for i, own in hits.items() for r in _decide(own, share, least)]
            if len(out) > 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), kind, pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([bool(v) for v in c] if pa.types.is_boolean(t) else c, t) for c, t in zip(cols, types, strict=True)],
                                          names=["k", "item", "windows", "item_windows", "same_values"])
    return run


def _windows_of(widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, os, _ in texts(batches):
            b = W.batch(os)
            t, keys = template(b), np.array(ks, np.int64)
            for width in widths:
                h, text, at, exact = windows(t, width)
                slots = [() if e else _values(b, t, i, p, width) for i, p, e in zip(text, at, exact, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[text]), pa.array(np.full(len(h), width, np.int32)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int64)), pa.array(slots, pa.list_(pa.string()))],
                    names=["k", "width", "hash", "dpos", "dslots"])
    return run
