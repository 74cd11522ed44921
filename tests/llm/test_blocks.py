"""Comparisons that go block by block, and what tasks hold at once."""
from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from tripleframe.llm import lines
from tripleframe.llm import rows as rows_


def test_large_groups_of_lines_meet_in_blocks(monkeypatch):
    """Before, each line of a large group was compared by a call of its own."""
    calls, real = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(1) or real(x))
    draw = np.random.Generator(np.random.PCG64(5))
    words = ["common", *(f"w{i}" for i in range(200))]
    made = [["common", *draw.choice(words, 150)] for _ in range(1200)]
    made += [[*made[j][:148], "new", str(j)] for j in range(0, 1200, 40)]
    text = "\n".join(" ".join(x) for x in made).encode()
    rows = pa.record_batch({"k": pa.array([1], pa.int64()), "o": pa.array([text.decode()])})
    counts = np.zeros(lines.COUNTERS, np.int64)
    packed = pa.Table.from_batches(lines._prefixes(counts, 80, 1)(iter([rows])))
    calls.clear()
    got = lines._pairs(80, None)(packed).to_pylist()
    assert len(calls) < 10_000  # 52,163 before
    assert {(1200 + j // 40, j) for j in range(0, 1200, 40)} <= {(r["line"], r["line2"]) for r in got}


def test_texts_become_objects_by_piece():
    """Before, all texts of a batch were Python objects at once."""
    n = 400
    batch = pa.record_batch({"k": pa.array(range(n), pa.int64()), "o": pa.array(["x" * 100_000] * n)})
    tracemalloc.start()
    seen = [len(ks) for ks, _, _ in rows_.texts([batch], 1 << 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(seen) == n and max(seen) == 10 and peak < 10 << 20
