"""Ground-truth labels and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import ids
from ..functions import scope as S
from .scan import first_rows


def best_candidate(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Highest scope priority, then lowest chunk index."""
    return first_rows(
        candidates, keys, [S.label_score(F.col("scope_path")).desc(), ids.chunk_index(F.col("chunk_id")), F.col("chunk_id")]
    )


def first_header(chunks: DataFrame, key: str = "bundle_id", order: str = "chunk_ord") -> DataFrame:
    """First non-empty column header of a bundle in chunk order."""
    flat = chunks.where(F.size("column_headers") > 0).select(key, order, F.posexplode("column_headers").alias("pos", "h"))
    filled = flat.where(F.coalesce("h.header", F.lit("")) != "")
    return first_rows(filled, [key], [F.col(order), F.col("pos")]).select(key, F.col("h.header").alias("header_value"))


def label_bundles(bundles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchors per bundle: bundle_id, anchor_type, anchor_value, expected_chunk_id.

    bundles: bundle_id, filename. chunks: bundle_id, chunk_ord and the chunk. A form-field
    anchor needs the lot in the text of a chunk with form fields; a column-header anchor the
    header in both text and headers of a chunk.
    """
    lots = bundles.select("bundle_id", ids.lot_label(F.col("filename")).alias("anchor_value")).where("anchor_value is not null")
    fields = chunks.where(F.size("form_fields") > 0).join(lots, "bundle_id").where(F.contains("text", "anchor_value"))
    headers = first_header(chunks.join(bundles.select("bundle_id"), "bundle_id", "left_semi")).withColumnRenamed("header_value", "anchor_value")
    heads = (
        chunks.where(F.size("column_headers") > 0).join(headers, "bundle_id")
        .where(F.contains("text", "anchor_value") & F.exists("column_headers", lambda h: h.header == F.col("anchor_value")))
    )
    pick = lambda df, kind: best_candidate(df, ["bundle_id"]).select(
        "bundle_id", F.lit(kind).alias("anchor_type"), "anchor_value", F.col("chunk_id").alias("expected_chunk_id")
    )
    return pick(fields, "form_field").unionByName(pick(heads, "column_header"))


def skipped_bundles(bundles: DataFrame, anchors: DataFrame) -> DataFrame:
    return bundles.select("bundle_id").join(anchors.select("bundle_id").distinct(), "bundle_id", "left_anti")


def sidecar(bundles: DataFrame, anchors: DataFrame) -> DataFrame:
    """Manifest rows with their ground_truth list, empty where nothing was labelled."""
    truth = anchors.groupBy("bundle_id").agg(
        F.sort_array(F.collect_list(F.struct("anchor_type", "anchor_value", "expected_chunk_id")), asc=False).alias("ground_truth")
    )
    empty = F.array().cast("array<struct<anchor_type:string,anchor_value:string,expected_chunk_id:string>>")
    return bundles.join(truth, "bundle_id", "left").withColumn("ground_truth", F.coalesce("ground_truth", empty))


def anchors_from_sidecar(bundles: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors of the wanted bundles, and the bundles skipped with the reason."""
    joined = bundles.select("bundle_id").join(rows.select("bundle_id", "ground_truth", F.lit(True).alias("_in")), "bundle_id", "left")
    anchors = joined.select("bundle_id", F.explode("ground_truth").alias("a")).select("bundle_id", "a.*")
    skipped = joined.where(F.col("_in").isNull() | (F.size("ground_truth") <= 0)).select(
        "bundle_id", F.when(F.col("_in").isNull(), "not_in_sidecar").otherwise("empty_ground_truth").alias("reason")
    )
    return anchors, skipped


def expected_ranks(anchors: DataFrame, hits: DataFrame, top: int = 10) -> DataFrame:
    """Rank of the expected chunk within the first `top` hits, null when absent.

    hits: query_id, arm, chunk_id, rank. One row per anchor and arm that found it.
    """
    found = hits.where(F.col("rank") <= top).select("query_id", "arm", F.col("chunk_id").alias("expected_chunk_id"), "rank")
    return anchors.join(found, ["query_id", "expected_chunk_id"], "left")


def recall_by_type(anchors: DataFrame, on_hits: DataFrame, off_hits: DataFrame, top: int = 10) -> DataFrame:
    """Recall with and without boost per anchor type, all three types always listed."""
    spark = anchors.sparkSession
    rank = lambda df, name: df.where(F.col("rank") <= top).groupBy("query_id", F.col("chunk_id").alias("expected_chunk_id")).agg(
        F.min("rank").alias(name)
    )
    ranked = anchors.join(rank(on_hits, "on_rank"), ["query_id", "expected_chunk_id"], "left").join(
        rank(off_hits, "off_rank"), ["query_id", "expected_chunk_id"], "left"
    )
    per = ranked.groupBy("anchor_type").agg(
        F.count(F.lit(1)).alias("total"), F.count("on_rank").alias("on_hits"), F.count("off_rank").alias("off_hits")
    )
    types = spark.createDataFrame([(t,) for t in K.ANCHOR_TYPES], "anchor_type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return types.join(per, "anchor_type", "left").select("anchor_type", zero("total"), zero("on_hits"), zero("off_hits")).withColumn(
        "delta", F.col("on_hits") - F.col("off_hits")
    )


def recall_verdict(by_type: DataFrame) -> DataFrame:
    d = F.sum("on_hits") - F.sum("off_hits")
    return by_type.agg(
        F.sum("total").alias("total"), d.alias("delta"),
        F.when(d > 0, "PASS").when(d == 0, "NEUTRAL").otherwise("REGRESS").alias("verdict"),
    )


def recall_at(expected: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Summed recall per arm: hits among expected over expected. expected: query_id, chunk_id."""
    total = expected.agg(F.count(F.lit(1)).alias("n_expected"), F.lit(1).alias("_k"))
    found = hits.join(expected, ["query_id", "chunk_id"], "left_semi").groupBy("arm").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks], F.lit(1).alias("_k")
    )
    return found.join(total, "_k").drop("_k").withColumns({f"recall_{k}": F.col(f"hits_{k}") / F.col("n_expected") for k in ks})


def hybrid_verdict(recall: DataFrame, dense: str = "dense", hybrid: str = "hybrid", k: int = 10) -> DataFrame:
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col(f"recall_{k}")))
    delta = (pick(hybrid) - pick(dense)) * 100
    return recall.agg(delta.alias("delta_pct"), F.when(delta < -5.0, "HURTS").otherwise("ACCEPTABLE").alias("verdict"))


def case_tally(results: DataFrame) -> DataFrame:
    """PASS / FAIL / ERROR per golden case: results has case, expected, actual, error."""
    status = F.when(F.col("error").isNotNull(), "ERROR").when(F.col("expected").eqNullSafe(F.col("actual")), "PASS").otherwise("FAIL")
    return results.withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("cases"))
