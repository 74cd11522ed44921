"""Adding up arrays that tasks send, in a tree, so that neither one task nor the driver meets one array per task."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

GROUPS = 64


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], dtype: type = np.float64) -> np.ndarray | None:
    """The sum over all tasks of ``partial`` (flat arrays of one size), or None if no task has any.

    Tasks are dealt to 64 groups that add up what theirs sent; the driver adds up the groups.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = partial(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([np.asarray(out, dtype).tobytes()])], names=["g", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for v in group.column("v"):
            x = np.frombuffer(v.as_py(), dtype)
            total = x.copy() if total is None else total + x
        return pa.table({"g": group.column("g")[:1], "v": [total.tobytes()]})

    parts = rows.mapInArrow(send, "g int, v binary").groupBy("g").applyInArrow(add, "g int, v binary").collect()
    return sum(np.frombuffer(r.v, dtype) for r in sorted(parts, key=lambda r: r.g)) if parts else None
