"""Audit-log analytics: validation, traces, replay, counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from .scan import first_rows


def required_fields(spark, schemas: dict[str, list[str]] | None = None) -> DataFrame:
    """Event schema registry as a small fixed table."""
    rows = [(event, sorted(fields)) for event, fields in (schemas or K.EVENT_FIELDS).items()]
    return spark.createDataFrame(rows, "event string, required array<string>")


def missing_fields(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events that lack required fields, with the missing names. `fields` is a map."""
    return (
        events.join(rules, "event")
        .withColumn("missing", F.array_sort(F.array_except("required", F.map_keys("fields"))))
        .where(F.size("missing") > 0)
        .drop("required")
    )


def validated(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events that may be written: unregistered ones, and registered ones that are complete."""
    return events.join(rules, "event", "left").where(
        F.col("required").isNull() | (F.size(F.array_except("required", F.map_keys("fields"))) == 0)
    ).drop("required")


def replay_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin(*K.REPLAY_EVENTS) & (F.coalesce("trace_id", F.lit("")) != ""))


def trace_count(events: DataFrame) -> DataFrame:
    """Number of distinct traces, counted by grouping so that no task holds them all."""
    return replay_events(events).groupBy("trace_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("traces"))


def traces(events: DataFrame, trace_ids: DataFrame | None = None, scope_prefix: Column | None = None) -> DataFrame:
    """Replay events of the wanted traces, in order; optional scope prefix on text or path."""
    rows = replay_events(events)
    if trace_ids is not None:
        rows = rows.join(trace_ids, "trace_id", "left_semi")
    if scope_prefix is not None:
        scope = F.col("scope_path")
        kind = dict(events.dtypes).get("scope_path", "string")
        if kind.startswith("array"):
            rows = rows.where(F.slice(scope, F.lit(1), F.size(scope_prefix)) == scope_prefix)
        else:
            rows = rows.where(F.coalesce(scope, F.lit("")).startswith(scope_prefix))
    return rows


def trace_summary(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Per trace: snapshot and details of its first solve start, else of its first event."""
    start_first = (F.col("event") != "constraint_solve_started").cast("int")
    counts = rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_events"))
    heads = first_rows(rows, ["trace_id"], [start_first, *order]).select("trace_id", "lineage_snapshot", "conflict_details")
    return counts.join(heads, "trace_id")


def replay_pairs(events: DataFrame, order: list[Column]) -> DataFrame:
    """First start and first solved event of every trace, with the prior inputs and result.

    outcome: ready, or incomplete_prior_solve when one of the two is missing.
    """
    rows = replay_events(events)
    started = first_rows(rows.where(F.col("event") == "constraint_solve_started"), ["trace_id"], order).select(
        "trace_id", F.col("query").alias("prior_query"), F.col("scope_path").alias("prior_scope"), F.lit(True).alias("_s")
    )
    solved = first_rows(rows.where(F.col("event") == "constraint_solved"), ["trace_id"], order).select(
        "trace_id", F.coalesce("branches_count", F.lit(0)).alias("prior_branches"), F.lit(True).alias("_d")
    )
    return started.join(solved, "trace_id", "full_outer").select(
        "trace_id", "prior_query", "prior_scope", "prior_branches",
        F.when(F.col("_s") & F.col("_d"), "ready").otherwise("incomplete_prior_solve").alias("outcome"),
    )


def replay_match(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Prior against new result: equal branch counts, and equal full results as a stricter flag.

    results: trace_id, branches_count, result_hash; pairs may hold prior_hash.
    """
    joined = pairs.where(F.col("outcome") == "ready").join(results, "trace_id")
    prior = F.col("prior_hash") if "prior_hash" in pairs.columns else F.lit(None).cast("string")
    return joined.select(
        "trace_id", "prior_branches", "branches_count",
        (F.col("prior_branches") == F.col("branches_count")).alias("deterministic_match"),
        (prior == F.col("result_hash")).alias("full_match"),
    )


def failures_in(events: DataFrame, targets: DataFrame, event: str = K.STORE_FAILURE_EVENT) -> DataFrame:
    """How many failure events belong to the target traces."""
    return events.where(F.col("event") == event).join(targets.select("trace_id").distinct(), "trace_id", "left_semi").agg(
        F.count(F.lit(1)).alias("failures")
    )


def is_route_template(path: Column) -> Column:
    return F.coalesce(path.rlike(K.ROUTE_TEMPLATE), F.lit(False))


def counters(rows: DataFrame, labels: list[str], endpoint: str | None = None) -> DataFrame:
    """Count per label set; rows whose endpoint is not a template are dropped."""
    kept = rows.where(F.col(endpoint).isNull() | is_route_template(F.col(endpoint))) if endpoint else rows
    return kept.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def histogram(rows: DataFrame, labels: list[str], value: str, edges: list[float]) -> DataFrame:
    """Cumulative bucket counts at fixed edges plus +Inf, with sum and count, in one pass."""
    cols = [F.count_if(F.col(value) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    wide = rows.groupBy(*labels).agg(*cols, F.count(value).alias("total"), F.sum(value).alias("value_sum"))
    buckets = F.array(
        *[F.struct(F.lit(float(e)).alias("le"), F.col(f"le_{i}").alias("bucket")) for i, e in enumerate(edges)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("bucket")),
    )
    return wide.select(*labels, F.inline(buckets), "total", "value_sum")
