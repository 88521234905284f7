"""Readers and writers of the side files: audit logs, manifests, checkpoints, lists, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K

AUDIT_FIELDS = (
    "timestamp STRING, event STRING, trace_id STRING, request_id STRING, doc_id STRING, query STRING, "
    "branches_count BIGINT, lineage_snapshot STRING, conflict_details STRING"
)


def parse_audit(lines: DataFrame, line: str = "value") -> DataFrame:
    """Audit events from JSON lines: known columns, scope_path and all fields as a map.

    Torn or corrupt lines are skipped. Order is whatever column the caller keeps.
    """
    good = lines.where(F.try_parse_json(line).isNotNull())
    scope = F.get_json_object(line, "$.scope_path")
    return good.select(
        *[c for c in lines.columns if c != line],
        F.inline(F.array(F.from_json(line, AUDIT_FIELDS))),
        F.from_json(line, "map<string,string>").alias("fields"),
        F.when(scope.startswith("["), F.from_json(scope, "array<string>")).when(scope.isNotNull(), F.split(scope, ",")).alias("scope_path"),
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Active and rotated (also compressed) log files."""
    return parse_audit(spark.read.text(path))


def write_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, with the writing time where none is given."""
    rows = events if "timestamp" in events.columns else events.withColumn(
        "timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str, n: int = 15) -> DataFrame:
    """First n bundles of recommended_first, or of full_list where that is missing or empty."""
    entry = "ARRAY<STRUCT<bundle_id: STRING, filename: STRING, doc_type: STRING, n_blocks: INT, sample_priority: STRING>>"
    raw = spark.read.option("multiLine", True).schema(f"recommended_first {entry}, full_list {entry}").json(path)
    chosen = F.when(F.coalesce(F.size("recommended_first"), F.lit(0)) > 0, F.col("recommended_first")).otherwise(F.col("full_list"))
    return raw.select(F.inline(F.slice(chosen, 1, n))).select(
        "bundle_id", "filename", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("sample_priority", F.lit("")).alias("sample_priority"),
    )


def write_sidecar(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "bundle_id STRING, filename STRING, ground_truth ARRAY<STRUCT<anchor_type: STRING, anchor_value: STRING, expected_chunk_id: STRING>>"
    ).json(path)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value", F.lit(K.SPACES)).alias("doc_hash")).where("doc_hash != ''").distinct()


def name_list(names: DataFrame, column: str = "doc_hash") -> DataFrame:
    """Distinct names in order. Sorted ranges stay apart, so the list may be any size."""
    return names.select(column).distinct().orderBy(column)


def write_name_list(names: DataFrame, path: str, column: str = "doc_hash") -> None:
    name_list(names, column).select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def parse_checkpoint(lines: DataFrame, line: str = "value") -> DataFrame:
    """Failed entries of run checkpoints: objects with doc_hash or name, or plain names."""
    items = F.from_json(F.get_json_object(line, "$.failed"), "array<string>")
    entry = lines.select(F.explode(items).alias("e"))
    as_object = F.col("e").startswith("{")
    field = lambda name: F.nullif(F.get_json_object("e", f"$.{name}"), F.lit(""))
    return entry.select(
        F.when(as_object, F.coalesce(field("doc_hash"), field("name"), F.lit(""))).otherwise(F.col("e")).alias("doc_hash"),
        F.when(as_object, F.get_json_object("e", "$.status")).alias("status"),
    )


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return parse_checkpoint(spark.read.text(path, wholetext=True))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_replace("path", "^file:", "").alias("source_path"), F.sha2("content", 256).alias("sha256")
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    from ..operators.store import with_keys, write_buckets

    write_buckets(with_keys(chunks), path)


def distinct_docs(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_hash").distinct().orderBy("doc_hash")


def chunks_from_cases(cases: DataFrame) -> DataFrame:
    """Text cases (name, raw_text, scope_path) as one-chunk documents ready to store."""
    from ..functions.text import estimate_tokens

    return cases.select(
        F.sha2("name", 256).alias("doc_hash"), F.lit(1).alias("version"), F.lit(0).cast("long").alias("chunk_index"),
        F.lit(None).cast("string").alias("chunk_id"), F.col("raw_text").alias("text"), "scope_path",
        F.array("name").alias("source_block_ids"), estimate_tokens(F.col("raw_text")).alias("token_count"),
        F.array(F.lit(1)).alias("page_numbers"), F.lit(None).cast("string").alias("doc_type"),
        F.array().cast("array<map<string,string>>").alias("form_fields"),
        F.array().cast("array<struct<index:int,header:string>>").alias("column_headers"),
        F.lit(False).alias("quality_warning"),
    )
