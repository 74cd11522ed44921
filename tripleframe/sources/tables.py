"""Tables as sources and results as sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.model import TRIPLE_COLS
from tripleframe.plans.support import cut_lineage

FETCH_SIZE = 10_000


def source(spark: SparkSession, what: str | DataFrame) -> DataFrame:
    """A DataFrame as it is, a parquet path, or the result of a read-only SQL query."""
    if isinstance(what, DataFrame):
        return what
    head = what.lstrip().split(None, 1)[0].lower() if what.strip() else ""
    if head in ("select", "with", "table", "values"):
        return spark.sql(what)
    return spark.read.parquet(what)


def jdbc_source(spark: SparkSession, url: str, query: str, properties: dict | None = None,
                partition_column: str | None = None, lower=None, upper=None, partitions: int = 64) -> DataFrame:
    """Query a database; with ``partition_column`` and its bounds, by that many parallel range reads."""
    reader = spark.read.format("jdbc").options(url=url, fetchsize=FETCH_SIZE, **(properties or {}))
    if partition_column is None:
        return reader.option("query", query).load()
    return reader.options(dbtable=f"({query}) t", partitionColumn=partition_column, lowerBound=lower,
                          upperBound=upper, numPartitions=partitions).load()


def bind(df: DataFrame, column_mappings: dict[str, str]) -> DataFrame:
    """The columns of a table under the property names they are bound to, ``{property: column}``."""
    return df.select(*[F.col(c).alias(p) for p, c in column_mappings.items()])


def cap_rows(df: DataFrame, n: int, keys: list[str] | None = None) -> tuple[DataFrame, bool]:
    """The first ``n`` rows by ``keys`` (then all other columns), and whether there were more."""
    order = list(dict.fromkeys([*(keys or []), *df.columns]))
    first = cut_lineage(df.orderBy(*order).limit(n + 1))
    return first.orderBy(*order).limit(n), first.count() > n


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def to_json(df: DataFrame, path: str) -> None:
    """One object per row; variables without a binding are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def preview(triples: DataFrame, q: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the triples that contain ``q``, ignoring case, in (s, p, o) order.

    ``has_more`` says on every row whether another page follows.
    """
    if limit < 1 or offset < 0:
        raise ValueError("a page holds at least one row and starts at 0 or later")
    needle = q.strip().lower()
    text = F.lower(F.concat_ws(" ", *TRIPLE_COLS[:3]))
    found = triples.select(*TRIPLE_COLS[:3]).where(text.contains(needle) if needle else F.lit(True)).orderBy(*TRIPLE_COLS[:3])
    # The row after the page, if there is one, is the only thing to know about what follows.
    following = found.offset(offset + limit).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_more"))
    return found.offset(offset).limit(limit).join(F.broadcast(following))
