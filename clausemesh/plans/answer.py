"""The questions a user asks: constraints for queries, direct calculation, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scope as S
from ..operators import constraints as C
from ..operators import solving as SO

ERROR_CODES = {"insufficient_recall": 404, "no_constraints_extracted": 404, "strict_inferred": 400, "conflict": 409}


def gates(recall: Column, constraints: Column, strict: Column, any_inferred: Column, status: Column) -> Column:
    """First failing gate of a query, or success."""
    return (
        F.when(F.coalesce(recall, F.lit(0)) < 1, "insufficient_recall")
        .when(F.coalesce(constraints, F.lit(0)) == 0, "no_constraints_extracted")
        .when(strict & F.coalesce(any_inferred, F.lit(False)), "strict_inferred")
        .when(status == "CONFLICT", "conflict")
        .otherwise("success")
    )


def gate_code(gate: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0))
    for name, code in ERROR_CODES.items():
        chain = chain.when(gate == name, F.lit(code))
    return chain.otherwise(F.lit(200))


def response_mode(active: Column) -> Column:
    return F.when(F.coalesce(F.size(active), F.lit(0)) > 0, "multi_branch").otherwise("single")


def constraints_of_hits(hits: DataFrame, order: Column, compat: bool = False) -> DataFrame:
    """Deduplicated constraints of every query's retrieved chunks, with ord in chunk order.

    hits: query_id, chunk columns, and a rank in `order`.
    """
    rows = hits.withColumn("_at", order.cast("long"))
    built = C.build_constraints(rows, ["query_id", "_at", "chunk_id"], compat=compat)
    best = C.dedup_constraints(built, ["query_id"], [F.col("_at"), F.col("hint_ord")])
    return best.withColumn("ord", F.col("_at") * 100_000 + F.col("hint_ord"))


def answer(queries: DataFrame, hits: DataFrame, order: str = "final_rank") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdict per query, ranges, trace) for queries with their retrieved chunks.

    queries: query_id, strict, active_scope. Every query gets a verdict.
    """
    built = constraints_of_hits(hits.drop("active_scope"), F.col(order)).join(queries.select("query_id", "active_scope"), "query_id")
    ranges = SO.solve_ranges(built, ["query_id"])
    status = SO.solve_status(ranges, ["query_id"])
    recall = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    counts = built.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_constraints"), F.bool_or("inferred").alias("any_inferred"))
    verdict = (
        queries.join(recall, "query_id", "left").join(counts, "query_id", "left").join(status, "query_id", "left")
        .withColumn("gate", gates(F.col("n_chunks"), F.col("n_constraints"), F.col("strict"), F.col("any_inferred"), F.col("status")))
        .select(
            "query_id", "gate", gate_code(F.col("gate")).alias("code"), F.coalesce("status", F.lit("EMPTY")).alias("status"),
            "primary_branch", F.coalesce("branches_count", F.lit(0)).alias("branches_count"),
            F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_constraints", F.lit(0)).alias("n_constraints"),
            response_mode(F.col("active_scope")).alias("mode"),
        )
    )
    return verdict, ranges, SO.solve_trace(built, ["query_id"])


def bad_primary_branch(status: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Results whose primary branch is not among their branches: expected to be none."""
    branches = ranges.where("solved").select(*keys, F.col("branch").alias("primary_branch")).distinct()
    return status.where(F.col("primary_branch").isNotNull()).join(branches, [*keys, "primary_branch"], "left_anti")


def calculate(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Direct solve of submitted constraints in their first form."""
    return SO.solve_with_fallback(SO.v1_to_v2(requests), keys)


def calculation_report(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request of calculate(): success, branches_count, and conflict_details, the parameters whose result
    is marked as conflict, in the order of their first constraints (null: none). A strict violation has no branches."""
    found = F.when(F.col("had_conflict"), F.struct("first_ord", F.col("parameter").alias("parameter")))
    per = results.groupBy(*keys).agg(
        F.bool_or(F.col("path") == "strict_violation").alias("_failed"), F.count("parameter").alias("branches_count"), F.sort_array(F.collect_list(found)).alias("_c"),
    )
    details = F.transform("_c", lambda c: F.struct(c["parameter"].alias("parameter"), F.lit("soft_fallback").alias("type")))
    return per.select(
        *keys, (~F.col("_failed")).alias("success"), "branches_count", F.when(F.size("_c") > 0, details).alias("conflict_details"),
        F.when(F.col("_failed"), "strict_violation").alias("error"),
    )


# --- written down only: life cycle filter, overlays and clause history -------------------------


def binding_only(constraints: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    rows = constraints.where(S.is_binding(F.col("lifecycle")))
    return rows.where(F.col("lifecycle").isin(*statuses)) if statuses else rows


def overlay(base: DataFrame, extra: DataFrame, keys: list[str], mode: Column) -> DataFrame:
    """User constraints on top of a solve: intersected with it, or put in its place.

    mode reads the columns of `extra`, one mode for each group; groups without extra constraints are left as they are.
    """
    replacing = extra.where(mode == "replace")
    both = SO.solve_ranges(base.unionByName(extra, allowMissingColumns=True), keys)
    alone = SO.solve_ranges(replacing, keys)
    group = [*keys, "branch", "parameter"]
    shape = lambda df, p: df.select(*group, *[F.col(c).alias(f"{p}_{c}") for c in ("range_lower", "range_upper", "had_conflict")])
    joined = shape(both, "i").join(shape(alone, "r"), group, "left")
    put = F.col("r_had_conflict").isNotNull()
    return joined.select(
        *group, *[F.when(put, F.col(f"r_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in ("range_lower", "range_upper", "had_conflict")]
    )


def clause_history(constraints: DataFrame) -> DataFrame:
    return constraints.where(F.col("provision_id").isNotNull()).orderBy("provision_id", "version")
