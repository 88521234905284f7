"""Ingest tasks: retry state machine, eligibility, resume, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import ids
from .scan import first_rows


def retry_eligible(tasks: DataFrame, now: Column, age: float = K.RETRY_AGE_SECONDS) -> DataFrame:
    return tasks.where(
        F.col("status").isin(*K.RETRY_STATUSES) & (F.col("unwired_skipped") == 0) & (F.col("updated_at") < now - F.lit(age))
    )


def append_error(history: Column, error: Column) -> Column:
    return F.when(F.coalesce(history, F.lit("")) == "", error).otherwise(F.concat_ws(" | ", history, error))


def claimable(now: Column, max_attempts: int = K.MAX_ATTEMPTS, age: float = K.RETRY_AGE_SECONDS) -> Column:
    return (
        F.col("status").isin(*K.RETRY_STATUSES) & (F.col("attempts") < max_attempts) & (F.col("updated_at") < now - F.lit(age))
    )


def retry_scan(
    tasks: DataFrame,
    now: Column,
    handler_ok: Column,
    handler_error: Column | None = None,
    wired: bool = True,
    max_attempts: int = K.MAX_ATTEMPTS,
    age: float = K.RETRY_AGE_SECONDS,
) -> DataFrame:
    """State of every eligible task after one scan, with the event the scan reports.

    Unwired: the task is set aside for good. Claimed: one more attempt, then COMPLETED
    (time refreshed) or FAILED (time kept, so that it is picked again; error appended).
    Not claimable: reported as a lost claim and left alone.
    """
    rows = retry_eligible(tasks, now, age)
    error = handler_error if handler_error is not None else F.lit(None).cast("string")
    if not wired:
        return rows.select(
            "request_id",
            F.lit("FAILED").alias("status"), "attempts", F.lit(K.UNWIRED_ERROR).alias("last_error"), "updated_at",
            F.lit(1).alias("unwired_skipped"), F.lit("handler_not_wired").alias("reason"), F.lit("skipped").alias("outcome"),
        )
    claim = claimable(now, max_attempts, age)
    ok = handler_ok & error.isNull()
    message = F.coalesce(error, F.lit(K.RETRY_FALSE_ERROR))
    return rows.select(
        "request_id",
        F.when(~claim, F.col("status")).when(ok, "COMPLETED").otherwise("FAILED").alias("status"),
        F.when(claim, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~claim, F.col("last_error")).when(ok, F.lit(None).cast("string"))
        .otherwise(append_error(F.col("last_error"), message)).alias("last_error"),
        F.when(claim & ok, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.col("unwired_skipped"),
        F.when(~claim, "claim_race_lost").when(error.isNotNull(), F.concat(F.lit("handler_failed:"), error))
        .otherwise("retry_invoked").alias("reason"),
        F.when(~claim, "skipped").when(ok, "success").otherwise("failed").alias("outcome"),
    )


def valid_outcome(outcome: Column) -> Column:
    return F.when(outcome.isin(*K.RETRY_OUTCOMES), outcome).otherwise("failed")


def outcome_status(rag_status: Column) -> Column:
    return F.when(rag_status == "success", "COMPLETED").otherwise("FAILED")


def outcome_error(rag_status: Column, error: Column) -> Column:
    """Error text of a failed outcome, cut at the limit."""
    return F.when(rag_status != "success", F.substring(F.coalesce(F.nullif(error, F.lit("")), F.lit("unknown")), 1, K.ERROR_TEXT_LIMIT))


def new_tasks(notices: DataFrame, tasks: DataFrame, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Notices not seen before, and duplicates. The first of equal notices, by `order` or else as they come, is the new one."""
    keyed = notices.withColumn("request_id", ids.request_id(F.col("trace_id"), F.col("doc_hash"), F.col("version")))
    unseen = keyed.join(tasks.select("request_id"), "request_id", "left_anti")
    fresh = first_rows(unseen, ["request_id"], order or [F.monotonically_increasing_id()])
    known = tasks.select("request_id").withColumn("_known", F.lit(1))
    seen = keyed.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).join(known, "request_id", "left").select(
        "request_id", (F.col("n") - F.when(F.col("_known").isNull(), 1).otherwise(0)).alias("duplicates")
    ).where("duplicates > 0")
    return fresh, seen


def replay_gate(requests: DataFrame, tasks: DataFrame, digests: DataFrame) -> DataFrame:
    """Why a finished ingest may or may not be run again.

    tasks: request_id, status, source_path, payload_sha256. digests: source_path, sha256.
    """
    found = tasks.withColumn("_found", F.lit(True))
    joined = requests.join(found, "request_id", "left").join(digests, "source_path", "left")
    verdict = (
        F.when(F.col("_found").isNull(), "not_found")
        .when(F.col("status").isin("PENDING", "RUNNING"), "in_flight")
        .when(F.col("status") != "COMPLETED", "not_completed")
        .when(F.coalesce("source_path", F.lit("")) == "", "pre_phase5")
        .when(F.col("sha256").isNull(), "file_missing")
        .when(~F.col("sha256").eqNullSafe(F.col("payload_sha256")), "sha256_mismatch")
        .otherwise("ok")
    )
    return joined.select("request_id", verdict.alias("reason"))


def resume(candidates: DataFrame, completed_events: DataFrame, statuses: DataFrame) -> DataFrame:
    """Candidates neither completed in the audit log nor already successful."""
    done = (
        completed_events.where((F.col("event") == "ingestion_completed") & (F.coalesce("doc_id", F.lit("")) != ""))
        .select(F.col("doc_id").alias("doc_hash"))
        .union(statuses.where(F.trim("status").isin(*K.DONE_STATUSES)).select("doc_hash"))
        .distinct()
    )
    return candidates.join(done, "doc_hash", "left_anti")


def resolve_failed(failed: DataFrame, corpus: DataFrame) -> DataFrame:
    """Failed names matched to corpus bundles without their run suffix; found tells hit or miss."""
    keyed = failed.select("doc_hash").distinct().withColumn("bundle_id", ids.strip_run_suffix(F.col("doc_hash")))
    known = corpus.select("bundle_id").distinct().withColumn("_hit", F.lit(True))
    return keyed.join(known, "bundle_id", "left").select("doc_hash", "bundle_id", F.coalesce("_hit", F.lit(False)).alias("found"))


def triage(failed: DataFrame, live: DataFrame | None) -> DataFrame:
    """A retry, B mislabeled, C real (with reason), D unknown, per failed checkpoint entry."""
    bad = F.col("status").isin("failed", "rejected")
    if live is None:
        return failed.select(
            "doc_hash",
            F.when(bad, "C").otherwise("A").alias("class"),
            F.when(bad, F.concat(F.lit("checkpoint_status="), F.col("status"))).alias("reason"),
        )
    joined = failed.join(live.select("doc_hash", "live_status"), "doc_hash", "left")
    seen = F.coalesce("live_status", F.lit("not_found"))
    return joined.select(
        "doc_hash",
        F.when(bad, "C").when(seen == "success", "B").when(seen.isin("failed", "rejected"), "C")
        .when(seen == "unreachable", "D").otherwise("A").alias("class"),
        F.when(bad, F.concat(F.lit("checkpoint_status="), F.col("status")))
        .when(seen.isin("failed", "rejected"), F.concat(F.lit("live_status="), seen)).alias("reason"),
    )


def run_counts(outcomes: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return outcomes.agg(
        F.count(F.lit(1)).alias("n_total"),
        n(*K.DONE_STATUSES).alias("n_completed"),
        n("failed").alias("n_failed"),
        n("rejected").alias("n_rejected"),
        n("pending", "rate_limited").alias("n_pending"),
        n("skipped_resumed").alias("n_skipped"),
    )
