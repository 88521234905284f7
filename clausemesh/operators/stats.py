"""Exact percentiles and run reports.

A percentile is the value at one rank. Ranks are found in two passes: counts per slice of a
group's value range locate the slice that holds a rank, then only those slices' distinct
values are ordered. No task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import HOT_ROWS, Running, running

SLICES = 4096


def nearest_rank(p: float, n: Column) -> Column:
    """Half-even rounding of p/100 * n, one-based, kept inside the group."""
    return F.least(F.greatest(F.bround(F.lit(p / 100.0) * n), F.lit(1)), n).cast("long")


def floor_rank(p: float, n: Column) -> Column:
    return F.greatest(F.floor(F.lit(p) * n), F.lit(1)).cast("long")


def linear_rank(p: float, n: Column) -> Column:
    return (F.least(F.greatest(F.bround(F.lit(p / 100.0) * (n - 1)), F.lit(0)), n - 1) + 1).cast("long")


def values_at_ranks(
    rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column | None], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per group with a column per named rank. A rank reads `n`; None is the maximum.

    A null key is a group like any other: keys travel as one struct, whose null fields compare as equal. Infinite values
    and NaN have slices of their own at the ends, so the finite range is cut evenly.
    """
    base = rows.where(F.col(value).isNotNull()).select(F.struct(F.lit(1).alias("_all"), *keys).alias("_g"), F.col(value).cast("double").alias("_v"))
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    span = base.groupBy("_g").agg(F.count("_v").alias("n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    located = base.join(span, "_g").withColumn(
        "_s",
        F.when(F.isnan("_v") | (F.col("_v") == float("inf")), F.lit(SLICES)).when(F.col("_v") == float("-inf"), F.lit(-1))
        .when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * SLICES), F.lit(SLICES - 1)))
        .otherwise(F.lit(0)),
    )
    slices = located.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"))
    # at most SLICES + 2 rows per group from here to the located slices
    order = W.partitionBy("_g").orderBy("_s")
    bounded = slices.withColumn("_upto", F.sum("_c").over(order))
    named = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("n") if r is None else r).cast("long").alias("rank")) for name, r in ranks.items()])
    targets = bounded.select("_g", "_s", "_upto", "_c", F.inline(named)).where(
        (F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c"))
    ).select("_g", "_s", "name", (F.col("rank") - (F.col("_upto") - F.col("_c"))).alias("_at"))
    wanted = targets.select("_g", "_s").distinct()
    distinct_values = located.join(wanted, ["_g", "_s"], "left_semi").groupBy("_g", "_s", "_v").agg(F.count(F.lit(1)).alias("_m"))
    cumulated = running(distinct_values, ["_g", "_s"], [F.col("_v")], {"_cum": Running("sum", F.col("_m"))}, hot_rows)
    hits = cumulated.join(targets, ["_g", "_s"]).where((F.col("_at") <= F.col("_cum")) & (F.col("_at") > F.col("_cum") - F.col("_m")))
    wide = hits.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return wide.join(span.select("_g", "n"), "_g").select(*[F.col("_g")[k].alias(k) for k in keys], *ranks, "n")


def nearest_percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    return values_at_ranks(rows, keys, value, {f"p{p:g}": nearest_rank(p, F.col("n")) for p in ps})


def floor_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    ranks: dict[str, Column | None] = {f"p{round(p * 100)}": floor_rank(p, F.col("n")) for p in (0.5, 0.95, 0.99)}
    return values_at_ranks(rows, keys, value, {**ranks, "max": None})


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    return values_at_ranks(rows, keys, value, {f"p{p:g}": linear_rank(p, F.col("n")) for p in ps})


def throughput_report(timings: DataFrame, seconds: str = "seconds", chunks: str = "chunks", threshold: float = 5.0) -> DataFrame:
    """Totals, per-document percentiles, chunks per second and the p99 gate, as one row."""
    p = nearest_percentiles(timings, [], seconds, [50.0, 95.0, 99.0]).withColumn("_k", F.lit(1))
    total = timings.agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(seconds).alias("total_seconds"), F.max(seconds).alias("max_seconds"),
        F.sum(chunks).alias("total_chunks"), F.lit(1).alias("_k"),
    )
    return total.join(p.drop("n"), "_k").select(
        "n_documents", "total_seconds", "p50", "p95", "p99", "max_seconds",
        F.when(F.col("total_seconds") > 0, F.col("total_chunks") / F.col("total_seconds")).otherwise(F.lit(0.0)).alias("chunks_per_second"),
        (F.col("p99") < threshold).alias("threshold_passed"),
    )


def chunk_budget(chunks: DataFrame, max_tokens: int) -> DataFrame:
    per_doc = chunks.groupBy("doc_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("token_count") > max_tokens).alias("over")
    )
    return per_doc.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("total_chunks"), F.avg("n").alias("avg_chunks"), F.sum("over").alias("violations")
    )


def chunk_spread(chunks: DataFrame) -> DataFrame:
    """Min, median, p99 and max chunks per document that has more than one."""
    per_doc = chunks.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n_chunks")).where("n_chunks > 1")
    n = F.col("n")
    return values_at_ranks(
        per_doc, [], "n_chunks", {"smallest": F.lit(1), "median": floor_rank(0.5, n), "p99": floor_rank(0.99, n), "largest": None}
    )


def count_mismatches(reported: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose stored chunk count differs from the reported one."""
    stored = chunks.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("stored"))
    return reported.join(stored, "doc_hash", "left").withColumn("stored", F.coalesce("stored", F.lit(0))).where("stored != chunks_indexed")


def id_collisions(chunks: DataFrame) -> DataFrame:
    """chunk_ids that name chunks of more than one document or version."""
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def is_deterministic(runs: DataFrame, case: str, result: str = "result") -> DataFrame:
    """Whether all repeats of a case gave one result."""
    return runs.groupBy(case).agg(
        F.count(F.lit(1)).alias("repeats"),
        (F.min(F.sha2(result, 256)) == F.max(F.sha2(result, 256))).alias("deterministic"),
    )
