"""From bundles of parsed blocks to a stored, searchable chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators import chunking as CH
from ..operators import store as ST
from ..session import stored
from ..sources import blocks as B


def ingest(
    notices: DataFrame,
    lines: DataFrame,
    index_names: DataFrame,
    indexed: DataFrame,
    max_tokens: int = K.MAX_CHUNK_TOKENS,
    counter: X.TokenCounter = X.estimate_tokens,
    rules=None,
    default=None,
    force: bool = False,
    blank_ok: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, outcomes) of all notices.

    notices: doc_hash, version, bundle_id. lines: bundle_id, line_no, value. index_names:
    bundle_id, file_name. indexed: doc_hash, version, chunks_indexed as stored so far; the
    newest stored version of a document counts, and an equal one is skipped unless forced.
    Lines are parsed and chunked once; chunks and outcomes come from the same stored rows. Text is
    moved once, by bundle and run of line numbers. blank_ok: a document without chunks is a success.
    """
    known = indexed.groupBy("doc_hash").agg(F.max("version").alias("_v"), F.max_by("chunks_indexed", "version").alias("_n"))
    marked = notices.join(known, "doc_hash", "left")
    same = F.coalesce(F.col("_v") == F.col("version"), F.lit(False)) & F.lit(not force)
    done = marked.where(same)
    todo = marked.where(~same).drop("_v", "_n")
    kind = B.classify(F.col("file_name"), rules, default).getField("doc_type")
    named = todo.join(index_names, "bundle_id", "left").withColumn("doc_type", kind)
    ranged = lines.withColumn("unit", CH.unit_of(F.col("line_no")))
    places = ranged.select("bundle_id", "unit").distinct().join(named.select("bundle_id", *CH.DOC, "doc_type"), "bundle_id")
    place, of_doc = F.struct("bundle_id", "unit"), W.partitionBy(*CH.DOC)
    places = stored(places.withColumn("alone", F.min(place).over(of_doc) == F.max(place).over(of_doc)), "ingest-places")
    # lines are never sent to all tasks, however small they are guessed to be
    parsed = B.parse_lines(ranged.hint("merge").join(places, ["bundle_id", "unit"])).withColumnRenamed("line_no", "block_ord")
    units = CH.bundle_units(parsed)
    several = not places.where(~F.col("alone")).isEmpty()
    if several:
        units = stored(units, "ingest-units")
    rows = stored(CH.chunk_single_units(units.where("alone"), max_tokens, counter, keep=["bundle_id", "bad"]), "ingest-chunks")
    chunks = rows.where(F.col("chunk_index").isNotNull()).select(*CH.CHUNK_COLUMNS)
    seen = rows.select("bundle_id", "bad")
    if several:
        rest = units.where(~F.col("alone"))
        good = rest.join(rest.where("bad").select("bundle_id").distinct(), "bundle_id", "left_anti")
        chunks = chunks.unionByName(stored(CH.chunk_unit_series(CH.joined_units(good), max_tokens, counter), "ingest-long"))
        seen = seen.unionByName(rest.select("bundle_id", "bad"))
    sizes = chunks.groupBy("doc_hash", "version").agg(F.count(F.lit(1)).alias("chunks_indexed"))
    present = places.select("bundle_id").distinct().withColumn("_file", F.lit(True))
    seen = seen.groupBy("bundle_id").agg(F.bool_or("bad").alias("_bad"))
    verdict = (
        todo.join(present, "bundle_id", "left").join(seen, "bundle_id", "left")
        .join(sizes, ["doc_hash", "version"], "left")
        .withColumn(
            "error_code",
            F.when(F.col("_file").isNull(), "jsonl_missing").when(F.col("_bad").isNull(), "jsonl_empty")
            .when(F.col("_bad"), "ir_parse_error").when(F.col("chunks_indexed").isNull() & F.lit(not blank_ok), "no_chunks"),
        )
        .select(
            "doc_hash", "version", F.when(F.col("error_code").isNull(), "success").otherwise("failed").alias("rag_status"),
            "error_code", F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"),
        )
    )
    skipped = done.select(
        "doc_hash", "version", F.lit("success").alias("rag_status"), F.lit(None).cast("string").alias("error_code"),
        F.col("_n").alias("chunks_indexed"),
    )
    return chunks, verdict.unionByName(skipped)


def reparse(notices: DataFrame, lines: DataFrame, indexed: DataFrame, force: bool = False, blank_ok: bool = False) -> tuple[DataFrame, DataFrame]:
    """Run stored sources again. Chunks carry no document type; an equal version is a duplicate
    unless forced, and any failure is a business failure."""
    names = notices.select("bundle_id", F.lit(None).cast("string").alias("file_name")).distinct()
    chunks, outcomes = ingest(notices, lines, names, indexed, force=force, blank_ok=blank_ok)
    same = indexed.select("doc_hash", "version", F.lit(True).alias("_dup"))
    renamed = outcomes.join(same, ["doc_hash", "version"], "left").withColumn(
        "rag_status",
        F.when(F.col("_dup") & F.lit(not force), "duplicate").when(F.col("rag_status") == "failed", "business_failure").otherwise(F.col("rag_status")),
    ).drop("_dup")
    return chunks.withColumn("doc_type", F.lit(None).cast("string")), renamed


def merge_store(stored: DataFrame, chunks: DataFrame, delete_old: bool = True) -> DataFrame:
    """Stored chunks after an ingest: new points replace equal ones, older versions go."""
    keyed = ST.with_keys(chunks)
    merged = ST.upsert(stored, keyed, ["point_id"], [F.col("chunk_index"), F.col("text")])
    if not delete_old:
        return merged
    keep = chunks.groupBy("doc_hash").agg(F.max("version").alias("keep_version"))
    return ST.delete_old_versions(merged, keep)
