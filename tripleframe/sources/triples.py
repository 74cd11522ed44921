"""Triples on disk: N-Triples text and a queryable store."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.functions.terms import XSD_NS, nt_unescape, object_to_nt
from tripleframe.model import RDF_TYPE, TRIPLE_COLS, TRIPLE_SCHEMA

# Terms of the public N-Triples grammar (IRIREF, BLANK_NODE_LABEL, STRING_LITERAL_QUOTE, LANGTAG). Possessive
# quantifiers, because Java matches them in a loop; others recurse once per escape and overflow the stack on long texts.
UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
IRIREF = rf"<(?:[^\x00-\x20<>\"{{}}|^`\\]|{UCHAR})*+>"
LABEL = r"_:[\p{L}\p{Nd}_](?:[\p{L}\p{Nd}\p{M}_.\-\u00B7]*[\p{L}\p{Nd}\p{M}_\-\u00B7])?"
QUOTED = rf'"[^"\\\n\r]*+(?:(?:\\[tbnrf"\'\\]|{UCHAR})[^"\\\n\r]*+)*+"'
LANGTAG = "@[A-Za-z]+(?:-[A-Za-z0-9]+)*+"
LINE = rf"^({IRIREF}|{LABEL})[ \t]*({IRIREF})[ \t]*(?:({IRIREF}|{LABEL})|({QUOTED})(?:\^\^({IRIREF})|({LANGTAG}))?)[ \t]*\.[ \t]*(?:#.*)?$"


_MARK = "\x01"


def to_nt(triples: DataFrame) -> DataFrame:
    """One text column ``value`` with a line per triple."""
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return triples.select(F.concat(s, F.lit(" <"), "p", F.lit("> "),
                                   object_to_nt(F.col("o"), F.col("o_kind"), F.col("o_type")),
                                   F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, compression: str = "none") -> None:
    to_nt(triples).write.mode("overwrite").option("compression", compression).text(path)


def _unwrap(col: Column) -> Column:
    """An IRI without brackets and escapes; a blank node as it is."""
    return F.when(col.startswith("<"), nt_unescape(F.substr(col, F.lit(2), F.length(col) - 2))).otherwise(col)


def parse_nt(lines: DataFrame) -> DataFrame:
    """Parse a ``value`` column; ``problem`` is NULL for a good triple, else says what is wrong.

    Blank lines vanish; lines that are comments are kept with the problem ``comment`` so that they can be counted. A comment behind a triple is
    left out. Escapes are characters in what is returned, in literals and in IRIs.
    """
    raw = lines.select(F.trim(F.col("value"), F.lit(" \t\r")).alias("line")).where("line <> ''").withColumn("utf8", F.is_valid_utf8("line"))
    # One match per line, which puts its parts one after the other; only text, the last of them, may hold the mark between them.
    readable = F.col("utf8") & ~F.col("line").startswith(_MARK)
    parts = F.regexp_replace(F.when(readable, F.col("line")).otherwise(""), LINE, "".join(f"{_MARK}${g}" for g in (1, 2, 3, 5, 6, 4)))
    # A row of its own, so that a condition on the outcome does not take the match along and make it again.
    cut = raw.select("line", "utf8", F.explode(F.array(parts)).alias("parts")).select("line", "utf8", F.explode(F.array(
        F.split(F.when(F.col("parts").startswith(_MARK), F.col("parts")), _MARK, 7))).alias("parts"))
    cut = cut.select("line", "utf8", *[F.coalesce(F.get("parts", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(("s", "p", "node", "datatype", "lang", "text"))])
    is_lit = F.col("text") != ""
    problem = (F.when(F.col("line").startswith("#"), "comment").when(~F.col("utf8"), "not_utf8").when(F.col("s") != "", None)
               .when(~F.col("line").endswith("."), "no_final_dot").otherwise("not_a_triple"))
    kind = _unwrap(F.col("datatype"))
    o_type = (F.when(~is_lit, None).when(F.col("lang") != "", F.col("lang"))
              .when(kind.startswith(XSD_NS), F.substr(kind, F.lit(len(XSD_NS) + 1)))
              .when(kind != "", kind).otherwise("string"))
    return cut.select(
        problem.alias("problem"), "line", _unwrap(F.col("s")).alias("s"), _unwrap(F.col("p")).alias("p"),
        F.when(is_lit, nt_unescape(F.substr("text", F.lit(2), F.length("text") - 2))).otherwise(_unwrap(F.col("node"))).alias("o"),
        F.when(is_lit, "lit").otherwise("iri").alias("o_kind"), o_type.alias("o_type"))


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples, and rejected lines with the reason. Comments and blank lines are in neither."""
    parsed = parse_nt(spark.read.text(path))
    return (parsed.where("problem is null").select(*TRIPLE_COLS),
            parsed.where("problem is not null and problem <> 'comment'").select("problem", "line"))


def ingest_report(spark: SparkSession, path: str, samples: int = 3, width: int | None = None) -> DataFrame:
    """One row per outcome: number of lines and the first few examples, whole or cut to ``width`` characters."""
    parsed = parse_nt(spark.read.text(path)).select(F.coalesce("problem", F.lit("triple")).alias("outcome"),
                                                    F.col("line") if width is None else F.left("line", F.lit(width)).alias("line"))
    from pyspark.sql import Window
    counts = parsed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    few = parsed.where("outcome <> 'triple'").withColumn("r", F.row_number().over(
        Window.partitionBy("outcome").orderBy("line"))).where(F.col("r") <= samples).groupBy("outcome").agg(
        F.sort_array(F.collect_list("line")).alias("samples"))
    return counts.join(few, "outcome", "left")


def save_triples(triples: DataFrame, path: str, clustered: bool = False) -> None:
    """Store triples in one folder per predicate, each file sorted by subject (types: by class first).

    Rows are rebalanced by predicate: one shuffle, in which small predicates share tasks and a predicate
    that holds a third of all triples is split into many files of the advisory size. Sorted files let a
    lookup skip row groups by their min/max values.

    ``clustered`` range-partitions by (predicate, subject) instead, so that a lookup opens few files; it
    pays for that with a sampling pass over ``triples``, which should then be cheap to read twice.
    """
    keys = [F.col("p"), F.when(F.col("p") == RDF_TYPE, F.col("o")), F.col("s")]
    rows = triples.select(*TRIPLE_COLS)
    rows = rows.repartitionByRange(*keys) if clustered else rows.hint("rebalance", "p")
    rows.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("p").parquet(path)


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRIPLE_SCHEMA)
    return spark.read.schema(schema).parquet(path).select(*TRIPLE_COLS)


def refresh_triples(triples: DataFrame, path: str, version: str) -> bool:
    """Rebuild a store only when ``version`` (say, a hash of the sources' state) is a new one.

    The version is written after the triples, so a broken rebuild is done again next time. Readers may meet a store that is half written;
    :class:`tripleframe.sources.store.TripleStore` keeps the old version readable and writes only what differs.
    """
    spark = triples.sparkSession
    mark = f"{path.rstrip('/')}_version"
    folder = spark._jvm.org.apache.hadoop.fs.Path(mark)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    if there and spark.read.text(mark).where(F.col("value") == version).limit(1).count() == 1:
        return False
    save_triples(triples, path)
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
    return True


def clear_triples(spark: SparkSession, path: str) -> None:
    """Leave an empty store behind."""
    spark.createDataFrame([], TRIPLE_SCHEMA).write.mode("overwrite").parquet(path)
