"""Interval intersection with conflicts, trace and soft fallback.

A parameter's range needs only the largest lower and the smallest upper bound, so it is a
plain aggregate: combined before the shuffle, safe for any group size. Only what depends on
the order of rows (trace, values up to the first conflict) uses ordered scans.

Input rows: the key columns, branch, parameter, interval STRUCT, unit, level, confidence,
scope_path, ord (input order, total within a key) and optionally active_scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import numbers as N
from ..functions import scope as S
from ..functions import units as U
from .hints import to_interval
from .scan import HOT_ROWS, Running, first_rows, running


def v1_to_v2(requests: DataFrame) -> DataFrame:
    """operator with lower / upper values -> interval; only temperatures change unit."""
    temp = U.is_temperature(F.col("unit"))
    conv = lambda c: F.when(temp, U.to_celsius(F.col(c), F.col("unit"))).otherwise(F.col(c))
    known = F.coalesce(to_interval(F.col("operator"), conv("lower"), conv("lower"), conv("upper")), F.struct(
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
        F.lit(True).alias("lower_inclusive"), F.lit(True).alias("upper_inclusive"),
    ))
    return requests.withColumns(
        {
            "parameter": U.normalize_parameter(F.col("parameter")),
            "interval": known,
            "unit": F.when(temp, F.lit("°C")).otherwise(F.col("unit")),
        }
    )


def _active(df: DataFrame) -> Column:
    return F.col("active_scope") if "active_scope" in df.columns else F.lit(None).cast("array<string>")


def _bounds(df: DataFrame) -> dict[str, Column]:
    lower, upper = F.col("interval.lower"), F.col("interval.upper")
    return {
        "lo": F.when(lower.isNotNull(), F.struct(lower.alias("v"), (~F.col("interval.lower_inclusive")).alias("open"))),
        "up": F.when(upper.isNotNull(), F.struct(upper.alias("v"), F.col("interval.upper_inclusive").alias("inc"))),
    }


def _is_empty(lo: Column, up: Column) -> Column:
    lower, upper = lo.getField("v"), up.getField("v")
    return F.coalesce(
        (lower > upper) | ((lower == upper) & ~(~lo.getField("open") & up.getField("inc"))), F.lit(False)
    )


def _solving_position(level: Column, confidence: Column, ord_: Column) -> Column:
    """One decimal that grows against solving order: its minimum marks the last row.

    Level and confidence (to 14 digits) share a long; one multiplication adds the order.
    """
    rank = level.cast("long") * 10**14 + F.round(confidence * 1e14).cast("long")
    step = F.lit("1" + "0" * 18).cast("decimal(19,0)")
    return (rank.cast("decimal(19,0)") * step + (F.lit(10**18 - 1) - ord_).cast("decimal(18,0)")).cast("decimal(38,0)")


def solve_ranges(constraints: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """One row per key, branch and parameter with its range or conflict.

    range_lower / range_upper follow the reporting rule that open or infinite bounds are
    null; lower / upper with their flags keep the true bounds. mixed_units tells that
    differing units met, which are intersected as they are.

    Rows are first reduced per unit with numeric buffers only, which keeps the big step a
    hash aggregate; the unit of the last row is chosen among the few rows left.
    """
    group = [*keys, *(extra if extra is not None else ["branch"]), "parameter"]
    lower, upper = F.col("interval.lower"), F.col("interval.upper")
    used = F.col("_used")
    rows = constraints.withColumn(
        "_used", S.constraint_in_scope(F.col("scope_path"), _active(constraints)) & F.col("interval").isNotNull()
    )
    per_unit = rows.groupBy(*group, "unit").agg(
        F.count_if(used).alias("n_applied"),
        F.max(F.when(used, lower)).alias("lo"),
        F.max(F.when(used & ~F.col("interval.lower_inclusive"), lower)).alias("lo_open"),
        F.min(F.when(used, upper)).alias("up"),
        F.min(F.when(used & ~F.col("interval.upper_inclusive"), upper)).alias("up_open"),
        F.min(F.when(used, F.col("confidence"))).alias("confidence"),
        F.min("ord").alias("first_ord"),
        F.min(F.when(used, _solving_position(F.col("level"), F.col("confidence"), F.col("ord")))).alias("last"),
    )
    agg = per_unit.groupBy(*group).agg(
        F.sum("n_applied").alias("n_applied"),
        F.max("lo").alias("lo"),
        F.max("lo_open").alias("lo_open"),
        F.min("up").alias("up"),
        F.min("up_open").alias("up_open"),
        F.min("confidence").alias("confidence"),
        F.min("first_ord").alias("first_ord"),
        F.min(F.when(F.col("last").isNotNull(), F.struct("last", "unit"))).getField("unit").alias("unit"),
        (F.count_if(F.col("n_applied") > 0) > 1).alias("mixed_units"),
    )
    lo_inc = ~F.coalesce(F.col("lo_open") == F.col("lo"), F.lit(False))
    up_inc = ~F.coalesce(F.col("up_open") == F.col("up"), F.lit(False))
    clash = F.coalesce(
        (F.col("lo") > F.col("up")) | ((F.col("lo") == F.col("up")) & ~(lo_inc & up_inc)), F.lit(False)
    )
    ok = (F.col("n_applied") > 0) & ~clash
    return agg.select(
        *group,
        "n_applied",
        "first_ord",
        ((F.col("n_applied") > 0) & clash).alias("had_conflict"),
        ok.alias("solved"),
        F.when(ok & lo_inc, F.col("lo")).alias("range_lower"),
        F.when(ok & up_inc, F.col("up")).alias("range_upper"),
        F.when(ok, F.col("lo")).alias("lower"),
        F.when(ok, F.col("up")).alias("upper"),
        F.when(ok & F.col("lo").isNotNull(), lo_inc).alias("lower_inclusive"),
        F.when(ok & F.col("up").isNotNull(), up_inc).alias("upper_inclusive"),
        F.when(ok, N.interval_text(F.col("lo"), lo_inc, F.col("up"), up_inc)).otherwise(F.lit("()")).alias("interval_text"),
        F.coalesce("unit", F.lit("°C")).alias("unit"),
        F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
        "mixed_units",
    )


def solve_status(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """OK / CONFLICT / EMPTY per key with the primary branch and counts."""
    # a branch's place is that of its first row, whether or not that row's parameter solved
    branches = ranges.groupBy(*keys, "branch").agg(
        F.bool_or("had_conflict").alias("any_conflict"), F.count_if("solved").alias("n_ranges"), F.count_if("had_conflict").alias("n_conflicts"),
        F.min("first_ord").alias("at"), F.bool_or("solved").alias("solved"),
    )
    per = branches.groupBy(*keys).agg(
        F.bool_or("any_conflict").alias("any_conflict"), F.sum("n_ranges").alias("n_ranges"), F.sum("n_conflicts").alias("n_conflicts"),
        F.count_if(F.col("solved") & F.col("branch").isNotNull()).alias("branches_count"),
        F.bool_or(F.col("solved") & (F.col("branch") == "general")).alias("has_general"),
        F.min(F.when(F.col("solved"), F.struct("at", "branch"))).getField("branch").alias("first_branch"),
    )
    return per.select(
        *keys,
        F.when(F.col("any_conflict"), "CONFLICT").when(F.col("n_ranges") == 0, "EMPTY").otherwise("OK").alias("status"),
        F.when(F.col("has_general"), "general").otherwise(F.col("first_branch")).alias("primary_branch"),
        "branches_count", "n_ranges", "n_conflicts",
    )


def _python_list(scope: Column) -> Column:
    inner = F.concat(F.lit("['"), F.array_join(scope, "', '"), F.lit("']"))
    return F.when(scope.isNull(), F.lit("None")).when(F.size(scope) == 0, F.lit("[]")).otherwise(inner)


def interval_record(interval: Column) -> Column:
    num = lambda c: F.when(c.isNull(), F.lit("None")).otherwise(N.plain_double(c))
    flag = lambda c: F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(
        F.lit("{'lower': "), num(interval.getField("lower")), F.lit(", 'upper': "), num(interval.getField("upper")),
        F.lit(", 'lower_inclusive': "), flag(interval.getField("lower_inclusive")),
        F.lit(", 'upper_inclusive': "), flag(interval.getField("upper_inclusive")), F.lit("}"),
    )


def solve_trace(
    constraints: DataFrame, keys: list[str], extra: list[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per constraint in solving order: action, interval before it, and reason.

    Rows in scope without an interval leave no trace.
    """
    group = [*keys, *(extra if extra is not None else ["branch"]), "parameter"]
    active = _active(constraints)
    rows = constraints.withColumn("_in", S.constraint_in_scope(F.col("scope_path"), active)).where(
        ~F.col("_in") | F.col("interval").isNotNull()
    )
    b = _bounds(rows)
    only = lambda c: F.when(F.col("_in"), c)
    order = [F.col("level").desc(), F.col("confidence").desc(), F.col("ord")]
    run = running(
        rows,
        group,
        order,
        {
            "_lo0": Running("max", only(b["lo"]), inclusive=False),
            "_up0": Running("min", only(b["up"]), inclusive=False),
            "_lo1": Running("max", only(b["lo"])),
            "_up1": Running("min", only(b["up"])),
            "step": Running("sum", F.lit(1)),
        },
        hot_rows,
    )
    before = F.when(_is_empty(F.col("_lo0"), F.col("_up0")), F.lit("()")).otherwise(
        N.interval_text(F.col("_lo0.v"), ~F.col("_lo0.open"), F.col("_up0.v"), F.col("_up0.inc"))
    )
    clash = _is_empty(F.col("_lo1"), F.col("_up1"))
    return run.select(
        *group,
        F.col("step").cast("long").alias("step"),
        "ord",
        F.when(~F.col("_in"), "skipped_scope").when(clash, "conflict").otherwise("applied").alias("action"),
        before.alias("interval_snapshot"),
        F.when(
            ~F.col("_in"), F.concat(F.lit("scope "), _python_list(F.col("scope_path")), F.lit(" != "), _python_list(active))
        ).when(
            clash, F.concat(F.lit("intersection with interval "), interval_record(F.col("interval")), F.lit(" is empty"))
        ).alias("reason"),
        "interval", "unit", "confidence",
        *[c for c in ("source_doc", "scope_path") if c in constraints.columns],
    )


def applied_confidence(trace: DataFrame, group: list[str]) -> DataFrame:
    """Smallest confidence over the rows applied before the first conflict, and their number."""
    return trace.groupBy(*group).agg(
        F.least(F.lit(1.0), F.coalesce(F.min(F.when(F.col("action") == "applied", F.col("confidence"))), F.lit(1.0)))
        .alias("confidence"),
        F.count_if(F.col("action") == "applied").alias("n_evidence"),
    )


def evidence(trace: DataFrame) -> DataFrame:
    """Evidence rows: source document and scope of every applied constraint."""
    return trace.where(F.col("action") == "applied")


def split_level(level: Column) -> Column:
    return F.when(level >= K.HARD_LEVEL, F.lit("hard")).otherwise(F.lit("soft"))


def solve_with_fallback(
    requests: DataFrame, keys: list[str], strict: str = "strict", allow: str = "allow_soft_fallback"
) -> DataFrame:
    """Direct solve: all rows first; if a parameter is empty, strict fails the request and
    otherwise only soft rows are solved, every result then marked as conflict.

    Returns one row per key and parameter with path in ('all', 'soft', 'strict_violation').
    """
    rows = requests.withColumn("_soft", F.col("level") < K.HARD_LEVEL)
    mode = rows.groupBy(*keys).agg(
        F.bool_or(F.col(strict)).alias("_strict"), F.bool_or(F.col(allow)).alias("_allow"),
        F.bool_or("_soft").alias("_has_soft"),
    )
    whole = solve_ranges(rows, keys, extra=[])
    soft = solve_ranges(rows.where("_soft"), keys, extra=[])
    verdict = (
        whole.groupBy(*keys).agg(F.bool_or(~F.col("solved")).alias("_any_empty")).join(mode, keys)
        .select(
            *keys,
            F.when(~F.col("_any_empty"), "all").when(F.col("_strict"), "strict_violation")
            .when(F.col("_allow") & F.col("_has_soft"), "soft").otherwise("all").alias("path"),
        )
    )
    confidence = applied_confidence(solve_trace(rows, keys, extra=[]), [*keys, "parameter"])
    soft_confidence = applied_confidence(solve_trace(rows.where("_soft"), keys, extra=[]), [*keys, "parameter"])
    cols = [*keys, "path", "parameter", "interval_text", "unit", "had_conflict", "lower", "upper", "solved", "first_ord"]
    all_part = whole.join(verdict.where("path = 'all'"), keys).select(*cols).join(confidence, [*keys, "parameter"], "left")
    soft_part = (
        soft.join(verdict.where("path = 'soft'"), keys).withColumn("had_conflict", F.lit(True)).select(*cols)
        .join(soft_confidence, [*keys, "parameter"], "left")
    )
    failed = verdict.where("path = 'strict_violation'").select(*keys, "path")
    return (
        all_part.unionByName(soft_part)
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
        .unionByName(failed, allowMissingColumns=True)
    )


def lineage_snapshot(requests: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """JSON of a request's constraints in input order, cut at the snapshot limit.

    Only the rows that can reach the limit are gathered; a row's JSON has at least five
    characters, as null fields are written too. The full length comes from an aggregate over
    all rows.
    """
    as_json = requests.withColumn("_json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    sizes = as_json.groupBy(*keys).agg((F.sum(F.length("_json") + 1) + 1).alias("size"))
    head = first_rows(as_json, keys, [F.col("ord")], k=K.SNAPSHOT_LIMIT // 5 + 1)
    whole = (
        head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "_json"))).alias("js"))
        .select(*keys, F.concat(F.lit("["), F.array_join("js._json", ","), F.lit("]")).alias("raw"))
        .join(sizes, keys)
    )
    cut = F.concat(F.substring("raw", 1, K.SNAPSHOT_LIMIT), F.lit(K.SNAPSHOT_MARK))
    return whole.select(
        *keys, F.when(F.col("size") > K.SNAPSHOT_LIMIT, cut).otherwise(F.col("raw")).alias("lineage_snapshot")
    )


