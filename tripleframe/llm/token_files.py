"""Flat token files: writing them, and counting the tokens of their documents without an index.

A file holds unsigned 16-bit ids, little end first, with an end-of-document id after every document and nothing else. The scan
reads blocks of any file at any place: each task finds the end ids of its block at once, and a prefix scan over the small
per-block counts says which document each block begins in and where that began.

Files are opened through Arrow's file systems on the executors, so the folder may be any that Arrow and all executors reach.
"""
from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleframe.llm.rows import literals as plain
from tripleframe.llm.tokens import encoder
from tripleframe.plans.support import cut_lineage

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 2 << 20
SPAN = 1024  # blocks whose counts are added up in one group


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_token_files(literals: DataFrame, folder: str, tokenizer: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Write one file per task; returns ``path``, ``ordinal`` (place in the file) and ``s`` of every literal, in a checkpoint.

    A NULL or empty text is a document without tokens; repeats and NULL subjects are documents as well. A task that is run
    again writes a file of another name, and the returned rows name only the files that count.
    """
    lits = plain(literals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode, n, out, path = TaskContext.get(), encoder(tokenizer), 0, None, ""
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                if out is None:
                    path = posixpath.join(folder, f"tokens-{context.partitionId():06d}-{context.taskAttemptId()}.bin")
                    system, name = _open(path)
                    system.create_dir(posixpath.dirname(name), recursive=True)
                    out = system.open_output_stream(name)
                raw, counts = encode(part.column("o").to_pylist())
                ids = np.full(len(raw) + len(part), end, "<u2")
                ids[np.arange(len(raw)) + np.repeat(np.arange(len(part)), counts)] = raw
                out.write(ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(n, n + len(part)), pa.int64()),
                                                  part.column("s")], names=["path", "ordinal", "s"])
                n += len(part)
        if out is not None:
            out.close()

    return cut_lineage(lits.mapInArrow(run, f"path string, ordinal long, s {lits.schema['s'].dataType.simpleString()}"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        n = [system.get_file_info(name).size // 2 for system, name in map(_open, paths)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int64())], names=["path", "n"])


def _ends(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _open(row["path"])
                with system.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(2 * row["size"], 2 * row["begin"]), "<u2")
                found = np.flatnonzero(ids == end) + row["begin"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[c]], t) for c, t in (("path", pa.string()), ("block", pa.int64()), ("begin", pa.int64()), ("size", pa.int64()))]
                    + [pa.array([found], pa.list_(pa.int64()))], names=["path", "block", "begin", "size", "ends"])
    return run


def count_tokens(spark: SparkSession, paths: DataFrame | list[str], end: int = END_OF_DOCUMENT,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``path``, ``ordinal``, ``start`` (in tokens), ``n_tokens`` and ``closed`` of every document in flat token files.

    ``paths`` is a list or a frame with a column ``path`` (repeats and NULL are dropped). ``n_tokens`` leaves the end id out; two
    end ids in a row are an empty document. Tokens after the last end id are a document that is not ``closed``. An empty
    file has no documents. A file is split into blocks, so one that holds a third of all tokens is read by many tasks.
    """
    files = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    files = files.select("path").where("path is not null").distinct()
    sized = files.mapInArrow(_sizes, "path string, n long").where("n > 0")
    blocks = sized.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block_tokens}"))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * block_tokens).alias("begin"),
                           F.least(F.lit(block_tokens), F.col("n") - F.col("block") * block_tokens).alias("size"))
    found = cut_lineage(blocks.repartition("path", "block").mapInArrow(
        _ends(end), "path string, block long, begin long, size long, ends array<long>"))
    # Prefix scan in two steps: sums over spans of blocks, then over the blocks of each span. The last end of a span is its largest.
    small = found.select("path", "block", F.expr(f"block div {SPAN}").alias("span"), F.size("ends").alias("n"),
                         F.array_max("ends").alias("last"), F.expr("begin + size").alias("stop"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    spans = small.groupBy("path", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    w, whole = before("path").orderBy("span"), Window.partitionBy("path")
    spans = spans.select("path", "span", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.max("last").over(w), F.lit(-1)).alias("last0"),
                         F.max("stop").over(whole).alias("total"), F.max("span").over(whole).alias("top"),
                         F.coalesce(F.max("last").over(whole), F.lit(-1)).alias("close"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("closes"))
    w = before("path", "span").orderBy("block")
    inner = small.select("path", "span", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n1"), F.max("last").over(w).alias("last1"))
    carry = inner.join(spans, ["path", "span"]).select(
        "path", "block", (F.col("n0") + F.col("n1")).alias("ordinal0"), F.coalesce("last1", "last0").alias("last"))
    docs = found.select("path", "block", "ends").join(carry, ["path", "block"]).select(
        "path", "ordinal0", "last", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("last")).otherwise(F.try_element_at("ends", F.col("i"))) + 1
    docs = docs.select("path", (F.col("ordinal0") + F.col("i")).alias("ordinal"), start.alias("start"),
                       (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = spans.where("span = top and close < total - 1").select(
        "path", F.col("closes").alias("ordinal"), (F.col("close") + 1).alias("start"),
        (F.col("total") - F.col("close") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(rest)
