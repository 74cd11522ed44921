"""Rows of literals as the operators of this package take them: keys, batches, and compact exchanges."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleframe.plans.support import cut_lineage

BATCH_BYTES = 8 << 20


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Make this library importable in Python workers, as ``--py-files`` would; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = Path(__file__).resolve().parents[1]
    file = os.path.join(tempfile.mkdtemp(prefix=top.name), f"{top.name}.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(file)
    _SENT.add(app)


def literals(df: DataFrame, s: str = "s", o: str = "o") -> DataFrame:
    """Only ``s`` and ``o`` (empty for NULL) of a frame that may have any other columns."""
    return df.select(F.col(s).alias("s"), F.coalesce(F.col(o).cast("string"), F.lit("")).alias("o"))


def spare(df: DataFrame, name: str) -> str:
    """``name``, or one like it that the frame does not use, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, s: str, o: str) -> tuple[DataFrame, str, bool]:
    """The frame with a key column, the name of that column, and whether no two rows share a key.

    The key is a long in the order of ``s`` (NULL first), then of a hash of the text ``o``. Different literals get different keys; rows
    that repeat both are one literal and share a key. Whole-number subjects without repeats are their own keys; others
    are ranked by one sort of (subject, hash) pairs, kept in the checkpoint folder so that a recomputed task finds the same numbers.
    """
    k, h = spare(df, "k"), spare(df, "h")
    if isinstance(df.schema[s].dataType, T.IntegralType):
        n, distinct = df.agg(F.count(F.lit(1)), F.countDistinct(df[s]) + F.coalesce(F.max(F.when(df[s].isNull(), 1).otherwise(0)), F.lit(0))).first()
        if n == distinct:
            return df.withColumn(k, F.coalesce(df[s].cast("long"), F.lit(-(1 << 63)))), k, True
    rows = df.withColumn(h, F.xxhash64(F.coalesce(df[o].cast("string"), F.lit(""))))
    ranks = cut_lineage(rows.select(F.col(s).alias("_s"), F.col(h).alias("_h")).distinct().orderBy(F.col("_s").asc_nulls_first(), "_h")
                        .withColumn("_k", F.monotonically_increasing_id()))
    rows = rows.join(ranks, rows[s].eqNullSafe(ranks["_s"]) & (rows[h] == ranks["_h"]))
    return rows.withColumn(k, F.col("_k")).select(*df.columns, k), k, False


def numbered(df: DataFrame) -> DataFrame:
    """Literals ``s``, ``o`` with a key ``k`` as :func:`keyed` makes it."""
    return keyed(literals(df), "s", "o")[0]


def texts(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[bytes], pa.RecordBatch]]:
    """Keys and UTF-8 texts of Arrow batches, cut so that a piece holds about ``limit`` bytes; at least one row each."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("o")).fill_null(0).to_numpy())
        at = 0
        while at < batch.num_rows:  # a piece at a time becomes Python objects, of a batch that may be large
            to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
            piece = batch.slice(at, to - at)
            yield piece.column("k").to_pylist(), piece.column("o").cast(pa.binary()).to_pylist(), piece
            at = to
        pa.default_memory_pool().release_unused()


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
