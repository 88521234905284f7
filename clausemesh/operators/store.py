"""Chunk store as Parquet snapshots: keys, versions, upserts, look-ups, drift."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import scope as S
from ..session import cut_lineage
from .scan import first_rows, numbered

#: Folders of a stored table. A document lies in one of them, so that replacing it reads and writes that one alone.
BUCKETS = 256


def doc_bucket() -> Column:
    return F.pmod(F.xxhash64("doc_hash"), F.lit(BUCKETS)).cast("int")


def with_keys(chunks: DataFrame) -> DataFrame:
    """chunk_id where missing, point_id, and the storage bucket of a chunk."""
    cid = F.coalesce("chunk_id", ids.chunk_id(F.col("doc_hash"), F.col("chunk_index")))
    return chunks.withColumn("chunk_id", cid).withColumns(
        {
            "point_id": ids.point_id(F.col("doc_hash"), F.col("version"), F.col("chunk_id")),
            "doc_bucket": doc_bucket(),
        }
    )


def index_chunks(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """chunk_index by position within a document."""
    out = numbered(chunks, ["doc_hash", "version"], order, "_n")
    return out.withColumn("chunk_index", F.col("_n") - 1).drop("_n")


def payload(chunks: DataFrame) -> DataFrame:
    """Stored fields with their defaults filled in."""
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return chunks.select(
        F.coalesce("text", F.lit("")).alias("text"),
        empty("scope_path", "array<string>").alias("scope_path"),
        empty("source_block_ids", "array<string>").alias("source_block_ids"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.coalesce("doc_hash", F.lit("")).alias("doc_hash"),
        F.coalesce("version", F.lit(0)).alias("version"),
        empty("page_numbers", "array<int>").alias("page_numbers"),
        "chunk_id",
        empty("form_fields", "array<map<string,string>>").alias("form_fields"),
        empty("column_headers", "array<struct<index:int,header:string>>").alias("column_headers"),
        "doc_type",
        F.coalesce("quality_warning", F.lit(False)).alias("quality_warning"),
    )


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows replace stored rows of the same key; the last of equal new keys counts, by `order` or else as they come."""
    by = [o.desc() for o in order] if order else [F.monotonically_increasing_id().desc()]
    last = first_rows(new, key, by)
    return existing.join(last.select(*key), key, "left_anti").unionByName(last)


def replace_docs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All stored rows of the documents in `new` give way to the new rows."""
    return existing.join(new.select("doc_hash").distinct(), "doc_hash", "left_anti").unionByName(new)


def write_buckets(rows: DataFrame, path: str) -> None:
    """Write whole buckets; only the buckets present in `rows` are overwritten, so these must hold all rows of theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def replace_stored_docs(rows: DataFrame, path: str) -> None:
    """Put the documents of `rows` in place of their stored rows. Other documents of the touched buckets are kept; other
    buckets are neither read nor written."""
    spark = rows.sparkSession
    fresh = cut_lineage(rows.withColumn("doc_bucket", doc_bucket()))
    touched = [r["doc_bucket"] for r in fresh.select("doc_bucket").distinct().collect()]  # BUCKETS numbers at most
    try:
        stored = spark.read.parquet(path).where(F.col("doc_bucket").isin(touched))
    except AnalysisException:  # nothing is stored yet
        write_buckets(fresh, path)
        return
    write_buckets(cut_lineage(replace_docs(stored.select(*fresh.columns), fresh)), path)


def delete_old_versions(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Drop versions strictly older than keep_version; newer ones survive out-of-order runs."""
    return chunks.join(keep.select("doc_hash", "keep_version"), "doc_hash", "left").where(
        F.col("keep_version").isNull() | (F.col("version") >= F.col("keep_version"))
    ).drop("keep_version")


def deleted_counts(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    return (
        chunks.join(keep.select("doc_hash", "keep_version"), "doc_hash")
        .groupBy("doc_hash").agg(F.count_if(F.col("version") < F.col("keep_version")).alias("deleted"))
    )


def delete_by(rows: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows left, and the number deleted per key."""
    left = rows.join(doomed.select(key).distinct(), key, "left_anti")
    counts = rows.join(doomed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return left, counts


def ingest_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_hash").agg(
        F.count(F.lit(1)).alias("chunks_indexed"), F.max("version").alias("version")
    ).withColumn("status", F.lit("success"))


def status_of(doc_hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    return doc_hashes.join(ingest_status(chunks), "doc_hash", "left").withColumn(
        "status", F.coalesce("status", F.lit("not_found"))
    )


def block_chunks(chunks: DataFrame) -> DataFrame:
    """block_id <-> chunk_id mapping with the block's position in the chunk."""
    return chunks.select("doc_hash", "chunk_id", F.posexplode("source_block_ids").alias("pos", "block_id"))


def find_blocks(chunks: DataFrame, block_ids: DataFrame) -> DataFrame:
    """Chunks that hold the wanted blocks."""
    owners = block_chunks(chunks).join(block_ids, "block_id").select("block_id", "doc_hash", "chunk_id")
    return owners.join(chunks, ["doc_hash", "chunk_id"])


def preview(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", F.substring("text", 1, 200).alias("text"), F.coalesce("doc_hash", F.lit("")).alias("doc_hash"))


def doc_prefix(chunks: DataFrame, prefix: str | Column) -> DataFrame:
    return chunks.where(F.coalesce("doc_hash", F.lit("")).startswith(prefix))


def active_count(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") != "illegal").alias("searchable"),
    )


def drift(full_text: DataFrame, vectors: DataFrame, migrating: Column | bool = False) -> DataFrame:
    """|active full-text rows - points|, 0 while a migration runs."""
    a = full_text.agg(F.count_if(F.col("status") == "active").alias("fts_count"), F.lit(1).alias("_k"))
    b = vectors.agg(F.count(F.lit(1)).alias("points"), F.lit(1).alias("_k"))
    off = F.lit(migrating) if isinstance(migrating, bool) else migrating
    return a.join(b, "_k").select(
        "fts_count", "points", F.when(off, F.lit(0)).otherwise(F.abs(F.col("fts_count") - F.col("points"))).alias("drift_count")
    )


def drifted_ids(full_text: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Which identifiers are on one side only."""
    a = full_text.where(F.col("status") == "active").select(key, F.lit(True).alias("in_fts"))
    b = vectors.select(key, F.lit(True).alias("in_points"))
    return a.join(b, key, "full_outer").where(F.col("in_fts").isNull() | F.col("in_points").isNull()).select(
        key, F.when(F.col("in_fts").isNull(), "missing_in_fts").otherwise("missing_in_points").alias("side")
    )


def list_documents(documents: DataFrame, prefix: str | None = None) -> DataFrame:
    """Documents whose comma-joined scope starts with the prefix; ASCII case is ignored."""
    if not prefix:
        return documents
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return documents.where(fold(F.col("scope_path")).startswith(fold(F.lit(prefix))))


def first_writer(documents: DataFrame) -> DataFrame:
    return first_rows(documents, ["doc_id"], [F.col("created_at"), F.col("ord")])


def last_writer(overrides: DataFrame, key: str = "scope_path") -> DataFrame:
    return first_rows(overrides, [key], [F.col("created_at").desc(), F.col("ord").desc()])


def mark_superseded(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with an outgoing edge are superseded."""
    old = edges.select(F.col("from_doc_id").alias("doc_id")).distinct().withColumn("superseded", F.lit(True))
    return documents.join(old, "doc_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))


def document_rows(notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document rows from notice metadata JSON with defaults, and notices that cannot give one.

    notices: request_id, metadata (JSON text), created_at. Notices without doc_metadata give
    neither; rejects never hold anything up.
    """
    meta = F.get_json_object("metadata", "$.doc_metadata")
    field = lambda name: F.get_json_object(meta, f"$.{name}")
    raw_scope = field("scope_path")
    scope = F.when(raw_scope.startswith("["), F.array_join(F.from_json(raw_scope, "array<string>"), ",")).otherwise(raw_scope)
    rows = notices.where(meta.isNotNull()).select(
        "request_id",
        field("doc_id").alias("doc_id"),
        F.coalesce(field("type"), F.lit("unknown")).alias("doc_type"),
        F.coalesce(scope, F.lit("")).alias("scope_path"),
        F.coalesce(field("status"), F.lit("active")).alias("status"),
        "created_at",
    )
    good = rows.where(F.col("doc_id").isNotNull())
    bad = rows.where(F.col("doc_id").isNull()).select(
        "request_id", F.lit("?").alias("doc_id"), F.lit("'doc_id'").alias("error")
    )
    return good, bad


def full_text_rows(chunks: DataFrame) -> DataFrame:
    """Second-form full-text rows: searchable text and scope plus JSON side columns."""
    return chunks.select(
        "chunk_id",
        F.coalesce(F.get("source_block_ids", F.lit(0)), F.lit("")).alias("block_id"),
        "text",
        S.scope_text(F.col("scope_path")).alias("scope_path"),
        F.lit("active").alias("status"),
        "doc_hash",
        F.to_json(F.struct("chunk_id", "doc_hash", "version")).alias("payload_json"),
        F.to_json(F.coalesce("form_fields", F.array().cast("array<map<string,string>>"))).alias("form_fields_text"),
        F.to_json(F.coalesce("column_headers", F.array().cast("array<struct<index:int,header:string>>"))).alias("column_headers_text"),
    )


def migrate_full_text(chunks: DataFrame, apply_to: str | None = None, limit: int | None = None) -> DataFrame:
    """Rebuild full-text rows of every document (or the first `limit` by name): doc_hash, outcome, rows_written.

    A document with a chunk that has no id or no text fails as a whole and is left as it is. Without a target path
    nothing is written; with one, the stored rows of other documents stay.
    """
    if limit is not None:
        chunks = chunks.join(chunks.select("doc_hash").distinct().orderBy("doc_hash").limit(limit), "doc_hash", "left_semi")
    bad = F.col("chunk_id").isNull() | F.col("text").isNull()
    verdict = chunks.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    if apply_to:
        good = chunks.join(verdict.where("_bad = 0").select("doc_hash"), "doc_hash", "left_semi")
        rows = full_text_rows(good).withColumn("doc_bucket", doc_bucket())
        replace_stored_docs(rows, apply_to)
    failed = F.col("_bad") > 0
    return verdict.select("doc_hash", F.when(failed, "failed").otherwise("migrated").alias("outcome"), F.when(failed, 0).otherwise(F.col("_n")).alias("rows_written"))
