"""From documents to training sequences: language, repeated lines, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all of ``docs``, whose columns it returns (the last one: pieces of sequences). Columns besides
``doc_id``, ``text``, ``lang`` and ``n_chars`` are carried along, whatever they are called; ``n_chars``, where there is one, follows the text.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleframe.llm.languages import learn_languages
from tripleframe.llm.leaks import leaked_items
from tripleframe.llm.lines import repeated_lines, without_lines
from tripleframe.llm.near_literals import near_classes
from tripleframe.llm.packing import pack_literals
from tripleframe.llm.queries import TOKENIZER
from tripleframe.llm.rows import keyed, send_package, spare
from tripleframe.plans.support import shared_dir

# No SQL for the whole: language profiles and sequences are beyond it. The tests compare it with plain Python.
ORACLE_SQL = None


def _base(docs: DataFrame) -> tuple[DataFrame, str, bool, DataFrame]:
    """Documents with a key column, its name, whether keys are unique, and the documents as numbered literals."""
    rows, k, unique = keyed(docs, "doc_id", "text")
    return rows, k, unique, rows.select(F.col("doc_id").alias("s"), F.coalesce("text", F.lit("")).alias("o"), F.col(k).alias("k"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that tagged documents are in; without any tag there is nothing to tell by, and all stay.

    Texts that are NULL or have no letter go, and texts that resemble every language less than all but one in a thousand of its tagged documents
    of like length do. Of a few words this may be any, so that texts of a few words in no known language may stay.
    """
    send_package(spark)
    known = docs.where("lang is not null").select(F.col("text").alias("o"), F.concat(F.lit("@"), "lang").alias("o_type"))
    profiles = learn_languages(known)
    if not profiles.tags:
        return docs
    return docs.where(profiles.resembles(F.col("text"), profiles.least_cosines(known)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line resembles (Jaccard of words 0.8 or more); rows that repeat id and text are one document.

    Earlier is a smaller id, NULL first, then a hash of the text, or above in the same text. NULL texts stay NULL, empty ones and lines without words stay as they
    are; a text of which every line goes becomes empty, and its document stays. Texts of any length are judged line by line.
    """
    send_package(spark)
    rows, k, unique, base = _base(docs)
    gone = spare(docs, "gone")
    lists = repeated_lines(base if unique else base.dropDuplicates(["k"]), 80).groupBy(F.col("k").alias(k)).agg(F.collect_list("line").alias(gone))
    text = without_lines(F.col("text"), F.col(gone))
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.join(lists, k, "left").withColumn("text", text).withColumns(size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group connected by five-word shingles with a similarity of 0.8 or more.

    Texts without words are like nothing and stay; of rows that repeat id and text one stays.
    """
    send_package(spark)
    rows, k, unique, base = _base(docs)
    kept = near_classes(base if unique else base.dropDuplicates(["k"]), 5, 80).where("k = c").select(F.col("k").alias(k))
    out = rows.join(kept, k, "left_semi")
    return (out if unique else out.dropDuplicates([k])).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    NULL and empty texts leak nothing and stay. Every row is judged by itself, repeated rows and ids as well, on its whole text, however long; without
    benchmark items all stay.
    """
    send_package(spark)
    rows, k, _, base = _base(docs)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select(F.col("item_id").alias("item"), F.col("text").alias("o"))
    bad = leaked_items(base, items).select(F.col("k").alias(k)).distinct()
    return rows.join(bad, k, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids.

    A NULL or empty text is its end id alone. Repeated rows are packed each; a long text is cut into as many pieces as it takes. No documents, no rows.
    """
    send_package(spark)
    out = pack_literals(docs.select(F.col("doc_id").alias("s"), F.col("text").alias("o")), TOKENIZER)
    return out.select(F.col("s").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what a stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
