"""From documents to tokens: reject poor and toxic documents, delete repeated lines, keep one of each group of near
copies, drop documents that hold benchmark passages, encode the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one.
All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemesh.llm import decontamination, line_dedup, near_copies, quality, sentencepiece_codec
from clausemesh.llm.common import key_id, table, unused
from clausemesh.session import fresh_path, ship_package

ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage sends the package to the executors itself, so that it can run alone."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, docs, sf_dir)

    return run


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs deleted; a document of which no line is left goes. n_chars follows the text."""
    lines, gone = unused(docs, "_lines", "_gone")
    rows = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=gone)
    rows = rows.where((F.col(gone) == 0) | (F.col(gone) < F.col(lines)))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col(gone) > 0, size).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


@stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: those that share 0.8 or more of their runs of five words."""
    return near_copies.keep_one(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    a, b = unused(docs, "_id", "_hash")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    found = found.select(F.col("k_id").alias(a), F.col("k_h").alias(b)).distinct()
    rows = docs.withColumns({a: key_id("doc_id"), b: F.xxhash64("text")})
    return rows.join(found, [a, b], "left_anti").select(*docs.columns)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding and against the original library."""
    return sentencepiece_codec.encode_documents(spark, docs).drop("text")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
