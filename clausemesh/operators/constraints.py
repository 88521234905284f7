"""From chunks to constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scope as S
from ..functions import units as U
from .hints import extract_hints, parse_intervals, parse_operators
from .scan import first_rows


def build_constraints(
    chunks: DataFrame,
    chunk: list[str],
    compat: bool = False,
    inferred: Column | None = None,
    superseded: Column | None = None,
) -> DataFrame:
    """One constraint per interval found: typed value, life cycle, priority, source, conditions.

    chunks needs text, scope_path and doc_hash; `chunk` names the columns that identify a
    chunk and keep input order (they are sorted on). compat pairs the n-th interval with
    the n-th hint of the chunk, as if every hint had given one.
    """
    hints = extract_hints(chunks, compat=compat)
    intervals = parse_intervals(hints, chunk, compat=compat)
    if compat:
        nth = W.partitionBy(*chunk).orderBy("hint_ord")
        picked = intervals.select(*chunk, "interval", (F.row_number().over(nth) - 1).alias("hint_ord"))
        norm = U.normalize_unit(F.col("value"), F.col("unit"))
        rows = hints.join(picked, [*chunk, "hint_ord"]).withColumn("norm_unit", norm.getField("unit"))
    else:
        rows = intervals
    point = F.coalesce(
        (F.col("interval.lower") == F.col("interval.upper"))
        & F.col("interval.lower_inclusive") & F.col("interval.upper_inclusive"),
        F.lit(False),
    )
    status = S.lifecycle_status(F.col("scope_path"), F.col("text"), superseded if superseded is not None else F.lit(False))
    conds = S.conditions(F.col("text"))
    return rows.select(
        *chunk,
        "hint_ord",
        U.normalize_parameter(F.col("parameter_hint")).alias("parameter"),
        F.when(point, "scalar").otherwise("interval").alias("value_type"),
        F.when(~point, F.col("interval")).alias("interval"),
        F.when(point, F.col("interval.lower")).alias("scalar_value"),
        F.col("norm_unit").alias("unit"),
        F.lit("general").alias("category"),
        S.scope_level(F.col("scope_path")).alias("level"),
        F.lit(1.0).alias("confidence"),
        (inferred if inferred is not None else F.lit(False)).alias("inferred"),
        status.alias("lifecycle"),
        S.is_binding(status).alias("is_binding"),
        F.col("doc_hash").alias("source_doc"),
        S.provision_id(F.col("scope_path")).alias("provision_id"),
        S.scope_doc_type(F.col("scope_path")).alias("source_doc_type"),
        conds.alias("conditions"),
        S.branch_key(conds).alias("branch"),
        "scope_path",
        F.col("source_text"),
        F.struct("start", "end").alias("span"),
    )


def dedup_constraints(constraints: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Best of equal (parameter, lower, upper, unit): level, then confidence, then input order.

    Scalars carry no interval, so all scalars of one parameter and unit are one.
    """
    keyed = constraints.withColumns({"_lo": F.col("interval.lower"), "_up": F.col("interval.upper")})
    best = [F.col("level").desc(), F.col("confidence").desc(), *order]
    return first_rows(keyed, [*group, "parameter", "_lo", "_up", "unit"], best).drop("_lo", "_up")


__all__ = ["build_constraints", "dedup_constraints", "parse_operators"]
