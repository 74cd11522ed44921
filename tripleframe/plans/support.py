"""Small helpers around execution: lineage cuts, size-checked broadcasts, session settings."""
from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after a count shows that it has at most this many rows.
BROADCAST_ROWS = 100_000

# Rows that a task groups where texts are compared. Spark sizes tasks by compressed bytes, of which texts that
# resemble each other have few, while groups in memory hold them whole.
TASK_ROWS = 500_000

# Settings that suit this library on a cluster; AQE then coalesces the many small partitions and
# splits skewed ones. Pass to SparkSession.builder.config(map=...).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tripleframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used in loops: the plan stays short, and a lost executor costs one re-read, not a recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a frame whose size was checked; otherwise leave the choice to Spark."""
    return F.broadcast(df) if is_small(df, rows) else df


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a task per :data:`TASK_ROWS` of at most ``rows`` rows; groupings by more keys need no further shuffle."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]):
    cond = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        cond = c if cond is None else cond & c
    return cond


def local_frame(spark: SparkSession, **columns: list[str | None]) -> DataFrame:
    """A small frame of strings. Arrow makes it a local relation, which Spark filters without a job."""
    return spark.createDataFrame(pa.table({n: pa.array(v, pa.string()) for n, v in columns.items()}))
