"""Interval solving, constraints and hints."""

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import scope as S
from ..functions import text as X
from ..functions import units as U
from ..operators import constraints as C
from ..operators import hints as H
from ..operators import solving as SO
from ..plans import answer as A
from .base import LINE_CONSTRAINTS, PART_CHUNKS, RANGES, line_constraints, part_chunks, query, rounded, table

SOLVE_SQL = f"""WITH {LINE_CONSTRAINTS}, {RANGES}
SELECT query_id, branch, parameter, n_applied, conflict AS had_conflict,
       round(CASE WHEN NOT conflict AND lo_inc THEN lo END, 6) AS range_lower,
       round(CASE WHEN NOT conflict AND up_inc THEN up END, 6) AS range_upper,
       round(confidence, 6) AS confidence, unit, mixed_units FROM g"""


@query("interval_solve", SOLVE_SQL)
def interval_solve(spark, d):
    """Intersection of all constraints per query, branch and parameter."""
    rows = line_constraints(spark, d).drop("scope_path").withColumn("scope_path", F.lit(None).cast("array<string>"))
    return SO.solve_ranges(rows, ["query_id"]).select(
        "query_id", "branch", "parameter", "n_applied", "had_conflict", rounded("range_lower"), rounded("range_upper"),
        rounded("confidence"), "unit", "mixed_units",
    )


@query(
    "solve_status",
    f"""WITH {LINE_CONSTRAINTS}, {RANGES},
b AS (SELECT query_id, branch, min(first_ord) AS place, bool_or(NOT conflict) AS solved FROM g GROUP BY query_id, branch),
p AS (SELECT query_id, branch FROM b WHERE solved QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, branch) = 1)
SELECT g.query_id, CASE WHEN bool_or(conflict) THEN 'CONFLICT' WHEN count(*) FILTER (NOT conflict) = 0 THEN 'EMPTY' ELSE 'OK' END AS status,
       any_value(p.branch) AS primary_branch, count(DISTINCT g.branch) FILTER (NOT conflict) AS branches_count,
       count(*) FILTER (NOT conflict) AS n_ranges, count(*) FILTER (conflict) AS n_conflicts
FROM g LEFT JOIN p ON p.query_id = g.query_id GROUP BY g.query_id""",
)
def solve_status(spark, d):
    rows = line_constraints(spark, d).withColumn("scope_path", F.lit(None).cast("array<string>"))
    return SO.solve_status(SO.solve_ranges(rows, ["query_id"]), ["query_id"])


@query("primary_branch_check", f"WITH {LINE_CONSTRAINTS}, {RANGES} SELECT DISTINCT query_id, 'none' AS primary_branch FROM g WHERE NOT conflict AND query_id % 7 = 0")
def primary_branch_check(spark, d):
    """Results whose primary branch is not one of their branches: those that were given a wrong one here."""
    rows = line_constraints(spark, d).withColumn("scope_path", F.lit(None).cast("array<string>"))
    ranges = SO.solve_ranges(rows, ["query_id"])
    status = SO.solve_status(ranges, ["query_id"])
    wrong = (F.col("query_id") % 7 == 0) & F.col("primary_branch").isNotNull()
    status = status.withColumn("primary_branch", F.when(wrong, "none").otherwise(F.col("primary_branch")))
    return A.bad_primary_branch(status, ranges, ["query_id"]).select("query_id", "primary_branch")


TRACE_SQL = f"""WITH {LINE_CONSTRAINTS},
t AS (SELECT *, row_number() OVER o AS step,
        max(CASE WHEN lower IS NOT NULL THEN (lower, CASE WHEN lower_inc THEN 0 ELSE 1 END) END) OVER (o ROWS UNBOUNDED PRECEDING) AS lo1,
        min(CASE WHEN upper IS NOT NULL THEN (upper, CASE WHEN upper_inc THEN 1 ELSE 0 END) END) OVER (o ROWS UNBOUNDED PRECEDING) AS up1
      FROM c WINDOW o AS (PARTITION BY query_id, branch, parameter ORDER BY level DESC, confidence DESC, ord)),
x AS (SELECT *, coalesce(lo1[1] > up1[1] OR (lo1[1] = up1[1] AND NOT (lo1[2] = 0 AND up1[2] = 1)), false) AS conflict FROM t)
SELECT query_id, branch, parameter, step, ord, CASE WHEN conflict THEN 'conflict' ELSE 'applied' END AS action FROM x"""


@query("solve_trace", TRACE_SQL)
def solve_trace(spark, d):
    """Every constraint in solving order with the action it led to."""
    rows = line_constraints(spark, d).withColumn("scope_path", F.lit(None).cast("array<string>"))
    return SO.solve_trace(rows, ["query_id"]).select("query_id", "branch", "parameter", "step", "ord", "action")


@query(
    "solve_evidence",
    f"""WITH {LINE_CONSTRAINTS},
t AS (SELECT *, max(CASE WHEN lower IS NOT NULL THEN (lower, CASE WHEN lower_inc THEN 0 ELSE 1 END) END) OVER o AS lo1,
        min(CASE WHEN upper IS NOT NULL THEN (upper, CASE WHEN upper_inc THEN 1 ELSE 0 END) END) OVER o AS up1
      FROM c WINDOW o AS (PARTITION BY query_id, branch, parameter ORDER BY level DESC, confidence DESC, ord ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, coalesce(lo1[1] > up1[1] OR (lo1[1] = up1[1] AND NOT (lo1[2] = 0 AND up1[2] = 1)), false) AS conflict FROM t)
SELECT query_id, branch, parameter, round(coalesce(min(confidence) FILTER (NOT conflict), 1.0::DOUBLE), 6) AS confidence,
       count(*) FILTER (NOT conflict) AS n_evidence FROM x GROUP BY query_id, branch, parameter""",
)
def solve_evidence(spark, d):
    """Confidence and evidence count over the rows applied before the first conflict."""
    rows = line_constraints(spark, d).withColumn("scope_path", F.lit(None).cast("array<string>"))
    trace = SO.solve_trace(rows, ["query_id"])
    return SO.applied_confidence(trace, ["query_id", "branch", "parameter"]).select(
        "query_id", "branch", "parameter", rounded("confidence"), "n_evidence"
    )


@query(
    "solve_in_scope",
    f"""WITH {LINE_CONSTRAINTS}
SELECT query_id, parameter, branch, count(*) FILTER (parameter = 'A' AND branch = 'F') AS n_applied
FROM c GROUP BY query_id, parameter, branch""",
)
def solve_in_scope(spark, d):
    """Only constraints whose scope is a prefix of the active scope take part."""
    rows = line_constraints(spark, d).withColumn("active_scope", F.array(F.lit("A"), F.lit("F"), F.lit("x")))
    return SO.solve_ranges(rows, ["query_id"]).select("query_id", "parameter", "branch", "n_applied")


@query(
    "constraint_dedup",
    f"""WITH {LINE_CONSTRAINTS}
SELECT query_id, parameter, round(lower, 6) AS lower, round(upper, 6) AS upper, unit, ord FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, parameter, lower, upper, unit ORDER BY level DESC, confidence DESC, ord) = 1""",
)
def constraint_dedup(spark, d):
    rows = C.dedup_constraints(line_constraints(spark, d), ["query_id"], [F.col("ord")])
    return rows.select(
        "query_id", "parameter", (F.round("interval.lower", 6) + 0.0).alias("lower"),
        (F.round("interval.upper", 6) + 0.0).alias("upper"), "unit", "ord",
    )


FALLBACK_SQL = f"""WITH {LINE_CONSTRAINTS},
k AS (SELECT query_id, parameter, count(*) AS n, max(lower) AS lo, min(upper) AS up,
        max(CASE WHEN NOT lower_inc THEN lower END) AS lo_open, min(CASE WHEN NOT upper_inc THEN upper END) AS up_open
      FROM c GROUP BY query_id, parameter),
ks AS (SELECT query_id, parameter, max(lower) AS lo, min(upper) AS up,
        max(CASE WHEN NOT lower_inc THEN lower END) AS lo_open, min(CASE WHEN NOT upper_inc THEN upper END) AS up_open
      FROM c WHERE level < 40 GROUP BY query_id, parameter),
a AS (SELECT *, coalesce(lo > up OR (lo = up AND (coalesce(lo_open = lo, false) OR coalesce(up_open = up, false))), false) AS conflict FROM k),
s AS (SELECT *, coalesce(lo > up OR (lo = up AND (coalesce(lo_open = lo, false) OR coalesce(up_open = up, false))), false) AS conflict FROM ks),
m AS (SELECT query_id, bool_or(conflict) AS bad FROM a GROUP BY query_id),
f AS (SELECT query_id, bool_or(level < 40) AS has_soft, query_id % 2 = 0 AS strict FROM c GROUP BY query_id),
v AS (SELECT query_id, CASE WHEN NOT bad THEN 'all' WHEN strict THEN 'strict_violation' WHEN has_soft THEN 'soft' ELSE 'all' END AS path
      FROM m JOIN f USING (query_id))
SELECT query_id, path, parameter, conflict AS had_conflict, round(CASE WHEN NOT conflict THEN lo END, 6) AS lower, round(CASE WHEN NOT conflict THEN up END, 6) AS upper
FROM a JOIN v USING (query_id) WHERE path = 'all'
UNION ALL SELECT query_id, path, parameter, true, round(CASE WHEN NOT conflict THEN lo END, 6), round(CASE WHEN NOT conflict THEN up END, 6) FROM s JOIN v USING (query_id) WHERE path = 'soft'
UNION ALL SELECT query_id, path, NULL, NULL, NULL, NULL FROM v WHERE path = 'strict_violation'"""


@query("soft_fallback", FALLBACK_SQL)
def soft_fallback(spark, d):
    """All rows first; an empty parameter fails a strict request or leaves only soft rows."""
    rows = line_constraints(spark, d).withColumns(
        {
            "scope_path": F.lit(None).cast("array<string>"), "strict": F.col("query_id") % 2 == 0,
            "allow_soft_fallback": F.lit(True),
        }
    )
    return SO.solve_with_fallback(rows, ["query_id"]).select(
        "query_id", "path", "parameter", "had_conflict", rounded("lower"), rounded("upper")
    )


@query(
    "hard_soft_split",
    f"WITH {LINE_CONSTRAINTS} SELECT query_id, count(*) FILTER (level >= 40) AS hard, count(*) FILTER (level < 40) AS soft FROM c GROUP BY query_id",
)
def hard_soft_split(spark, d):
    rows = line_constraints(spark, d).withColumn("side", SO.split_level(F.col("level")))
    return rows.groupBy("query_id").agg(F.count_if(F.col("side") == "hard").alias("hard"), F.count_if(F.col("side") == "soft").alias("soft"))


@query(
    "calculate_requests",
    """WITH r AS (
  SELECT o_custkey AS request_id, o_orderpriority AS parameter, o_orderkey AS ord,
         CASE o_orderstatus WHEN 'F' THEN '<=' WHEN 'O' THEN '>=' ELSE 'range' END AS operator,
         round(o_totalprice, 0) AS v FROM orders),
k AS (SELECT request_id, lower(replace(parameter, ' ', '_')) AS parameter,
        max(CASE operator WHEN '>=' THEN v WHEN 'range' THEN v END) AS lo,
        min(CASE operator WHEN '<=' THEN v WHEN 'range' THEN v + 1000 END) AS up FROM r GROUP BY 1, 2)
SELECT request_id, parameter, coalesce(lo > up, false) AS had_conflict,
  CASE WHEN lo > up THEN '()' WHEN lo = up THEN '[' || lo::VARCHAR || ']'
       ELSE coalesce('[' || lo::VARCHAR, '(-inf') || ',' || coalesce(up::VARCHAR || ']', '+inf)') END AS interval_text, 'mm' AS unit FROM k""",
)
def calculate_requests(spark, d):
    """Direct calculation over submitted constraints with interval text."""
    return A.calculate(_submitted(spark, d), ["request_id"]).select("request_id", "parameter", "had_conflict", "interval_text", "unit")


@query(
    "conflict_details",
    """WITH k AS (SELECT o_custkey AS request_id, lower(replace(o_orderpriority, ' ', '_')) AS parameter, min(o_orderkey) AS place,
        max(CASE WHEN o_orderstatus <> 'F' THEN round(o_totalprice, 0) END) AS lo,
        min(CASE o_orderstatus WHEN 'F' THEN round(o_totalprice, 0) WHEN 'O' THEN NULL ELSE round(o_totalprice, 0) + 1000 END) AS up,
        bool_or(o_custkey % 5 = 0) AS strict FROM orders GROUP BY 1, 2),
r AS (SELECT request_id, bool_or(strict) AND bool_or(coalesce(lo > up, false)) AS failed, count(*) AS n, string_agg(parameter || ':soft_fallback', ',' ORDER BY place) FILTER (lo > up) AS details FROM k GROUP BY 1)
SELECT request_id, NOT failed AS success, CASE WHEN failed THEN 0 ELSE n END AS branches_count, CASE WHEN NOT failed THEN details END AS details, CASE WHEN failed THEN 'strict_violation' END AS error FROM r""",
)
def conflict_details(spark, d):
    """What a request of direct calculation answers besides its ranges; every fifth customer is strict."""
    found = A.calculation_report(A.calculate(_submitted(spark, d).withColumn("strict", F.col("request_id") % 5 == 0), ["request_id"]), ["request_id"])
    details = F.array_join(F.transform("conflict_details", lambda c: F.concat_ws(":", c["parameter"], c["type"])), ",")
    return found.select("request_id", "success", "branches_count", details.alias("details"), "error")


def _submitted(spark, d):
    """Constraints as submitted: one request for each customer, one constraint for each order."""
    o = table(spark, d, "orders")
    v = F.round("o_totalprice", 0)
    return o.select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderpriority").alias("parameter"), F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") == "F", "<=").when(F.col("o_orderstatus") == "O", ">=").otherwise("range").alias("operator"),
        v.alias("lower"), (v + 1000).alias("upper"), F.lit("mm").alias("unit"), F.lit(40).alias("level"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("array<string>").alias("scope_path"), F.lit(False).alias("strict"), F.lit(True).alias("allow_soft_fallback"),
    )


@query(
    "lineage_snapshot",
    """WITH j AS (SELECT o_custkey AS request_id, o_orderkey AS ord,
   '{"parameter":"' || o_orderpriority || '","ord_key":' || o_orderkey::VARCHAR || '}' AS js FROM orders),
a AS (SELECT request_id, '[' || string_agg(js, ',' ORDER BY ord) || ']' AS raw FROM j GROUP BY request_id)
SELECT request_id, length(CASE WHEN length(raw) > 4096 THEN substring(raw, 1, 4096) || '...[truncated]' ELSE raw END) AS size,
       md5(CASE WHEN length(raw) > 4096 THEN substring(raw, 1, 4096) || '...[truncated]' ELSE raw END) AS digest FROM a""",
)
def lineage_snapshot(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("parameter"),
        F.col("o_orderkey").alias("ord_key"),
    )
    snap = SO.lineage_snapshot(rows, ["request_id"], ["parameter", "ord_key"])
    return snap.select("request_id", F.length("lineage_snapshot").cast("long").alias("size"), F.md5("lineage_snapshot").alias("digest"))


@query(
    "lineage_snapshot_cut",
    """WITH j AS (SELECT o_orderstatus AS request_id, o_orderkey AS ord,
   '{"parameter":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' AS js FROM orders),
a AS (SELECT request_id, '[' || string_agg(js, ',' ORDER BY ord) || ']' AS raw FROM j GROUP BY request_id)
SELECT request_id, CASE WHEN length(raw) > 4096 THEN substring(raw, 1, 4096) || '...[truncated]' ELSE raw END AS snapshot FROM a""",
)
def lineage_snapshot_cut(spark, d):
    """Requests of thousands of constraints, whose snapshots reach the limit; some fields are null."""
    some = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("request_id"), F.col("o_orderkey").alias("ord"), some.alias("parameter"))
    return SO.lineage_snapshot(rows, ["request_id"], ["parameter"]).select("request_id", F.col("lineage_snapshot").alias("snapshot"))


@query(
    "overlay_modes",
    f"""WITH {LINE_CONSTRAINTS},
e AS (SELECT o_orderkey AS query_id, 'F' AS branch, 'A' AS parameter, 2.0::DOUBLE AS lower, 30.0::DOUBLE AS upper, o_orderstatus FROM orders),
b AS (SELECT query_id, branch, parameter, lower, upper, lower_inc, upper_inc FROM c UNION ALL SELECT query_id, branch, parameter, lower, upper, true, true FROM e),
k AS (SELECT query_id, branch, parameter, max(lower) AS lo, min(upper) AS up, max(CASE WHEN NOT lower_inc THEN lower END) AS lo_open,
        min(CASE WHEN NOT upper_inc THEN upper END) AS up_open FROM b GROUP BY ALL),
x AS (SELECT k.*, coalesce(lo > up OR (lo = up AND (coalesce(lo_open = lo, false) OR coalesce(up_open = up, false))), false) AS conflict,
        (o.o_orderstatus = 'F' AND branch = 'F' AND parameter = 'A') AS put
      FROM k LEFT JOIN orders o ON o.o_orderkey = k.query_id)
SELECT query_id, branch, parameter,
  round(CASE WHEN put THEN 2.0::DOUBLE WHEN conflict OR coalesce(lo_open = lo, false) THEN NULL ELSE lo END, 6) AS range_lower,
  round(CASE WHEN put THEN 30.0::DOUBLE WHEN conflict OR coalesce(up_open = up, false) THEN NULL ELSE up END, 6) AS range_upper,
  CASE WHEN put THEN false ELSE conflict END AS had_conflict FROM x""",
)
def overlay_modes(spark, d):
    """User constraints intersected with a solve or put in its place (extension)."""
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderstatus")
    base = line_constraints(spark, d).withColumn("scope_path", F.lit(None).cast("array<string>"))
    extra = status.select(
        "query_id", F.lit("F").alias("branch"), F.lit("A").alias("parameter"),
        F.struct(F.lit(2.0).alias("lower"), F.lit(30.0).alias("upper"), F.lit(True).alias("lower_inclusive"), F.lit(True).alias("upper_inclusive")).alias("interval"),
        F.lit(100).alias("level"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("ord"), F.lit("mm").alias("unit"),
        F.lit(None).cast("array<string>").alias("scope_path"), F.when(F.col("o_orderstatus") == "F", "replace").otherwise("intersect").alias("mode"),
    )
    return A.overlay(base, extra, ["query_id"], F.col("mode")).select("query_id", "branch", "parameter", rounded("range_lower"), rounded("range_upper"), "had_conflict")


# --- hints and constraints from text -------------------------------------------------------------


@query(
    "spec_hints",
    f"""WITH {PART_CHUNKS}
SELECT chunk_id, 0 AS hint_ord, CASE k WHEN 5 THEN 'length' ELSE parameter END AS parameter_hint,
  CASE k WHEN 1 THEN p_size::DOUBLE + 0.5::DOUBLE WHEN 5 THEN 10.0::DOUBLE ELSE p_size::DOUBLE END AS value,
  CASE k WHEN 0 THEN 'mm' WHEN 1 THEN 'MPa' WHEN 2 THEN '°C' WHEN 3 THEN 'K' WHEN 4 THEN '%' ELSE 'cm' END AS unit FROM ph
UNION ALL SELECT chunk_id, 1, 'length', p_size::DOUBLE + 10, 'cm' FROM ph WHERE k = 5""",
)
def spec_hints(spark, d):
    """Numbers with units in the part texts."""
    return H.extract_hints(part_chunks(spark, d)).select("chunk_id", "hint_ord", "parameter_hint", "value", "unit")


@query(
    "spec_spans",
    f"""WITH {PART_CHUNKS}, tx AS (SELECT *, p_name || ': ' || CASE k WHEN 0 THEN 'length at most ' WHEN 1 THEN 'pressure at least ' WHEN 2 THEN '温度不得超过'
   WHEN 3 THEN '温度大于' WHEN 4 THEN '掺量 is ' ELSE 'from ' END AS lead FROM ph)
SELECT chunk_id, length(lead) AS start,
  length(lead) + length(CASE k WHEN 0 THEN p_size::VARCHAR || ' mm' WHEN 1 THEN p_size::VARCHAR || '.5 MPa' WHEN 2 THEN p_size::VARCHAR || '°C'
     WHEN 3 THEN p_size::VARCHAR || ' K' WHEN 4 THEN p_size::VARCHAR || '%' ELSE '10 cm' END) AS "end" FROM tx
UNION ALL SELECT chunk_id, length(lead) + 9, length(lead) + 9 + length((p_size + 10)::VARCHAR || ' cm') FROM tx WHERE k = 5""",
)
def spec_spans(spark, d):
    """Character offsets of the numbers."""
    return H.extract_hints(part_chunks(spark, d)).select("chunk_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    "spec_operators",
    f"""WITH {PART_CHUNKS}
SELECT chunk_id, operator, round(CASE WHEN k = 5 THEN 0.1::DOUBLE ELSE norm_value END, 6) AS norm_value, norm_unit, 0 AS hint_ord FROM ph
UNION ALL SELECT chunk_id, operator, round((p_size + 10)::DOUBLE * 0.01::DOUBLE, 6), norm_unit, 1 FROM ph WHERE k = 5""",
)
def spec_operators(spark, d):
    """Operator and value in base units for every hint."""
    rows = H.parse_operators(H.extract_hints(part_chunks(spark, d)))
    return rows.select("chunk_id", "operator", rounded("norm_value"), "norm_unit", "hint_ord")


@query(
    "spec_intervals",
    f"""WITH {PART_CHUNKS}
SELECT chunk_id, CASE WHEN k = 5 THEN 'length' ELSE parameter END AS parameter_hint,
  round(CASE k WHEN 1 THEN norm_value WHEN 3 THEN norm_value WHEN 4 THEN norm_value WHEN 5 THEN 0.1::DOUBLE END, 6) AS lower,
  round(CASE k WHEN 0 THEN norm_value WHEN 2 THEN norm_value WHEN 4 THEN norm_value WHEN 5 THEN (p_size + 10)::DOUBLE * 0.01::DOUBLE END, 6) AS upper,
  k <> 3 AS lower_inclusive, true AS upper_inclusive FROM ph""",
)
def spec_intervals(spark, d):
    """Intervals per chunk, equal ones kept once."""
    rows = H.parse_intervals(H.extract_hints(part_chunks(spark, d)), ["chunk_id"])
    return rows.select(
        "chunk_id", "parameter_hint", (F.round("interval.lower", 6) + 0.0).alias("lower"), (F.round("interval.upper", 6) + 0.0).alias("upper"),
        F.col("interval.lower_inclusive").alias("lower_inclusive"), F.col("interval.upper_inclusive").alias("upper_inclusive"),
    )


@query(
    "spec_first_form",
    f"""WITH {PART_CHUNKS}
SELECT chunk_id, parameter, operator,
  CASE k WHEN 1 THEN p_size::DOUBLE + 0.5::DOUBLE WHEN 5 THEN 10.0::DOUBLE ELSE p_size::DOUBLE END AS lower,
  CASE k WHEN 1 THEN p_size::DOUBLE + 0.5::DOUBLE WHEN 5 THEN p_size::DOUBLE + 10 ELSE p_size::DOUBLE END AS upper,
  CASE k WHEN 0 THEN 'mm' WHEN 1 THEN 'MPa' WHEN 2 THEN '°C' WHEN 3 THEN 'K' WHEN 4 THEN '%' ELSE 'cm' END AS unit FROM ph""",
)
def spec_first_form(spark, d):
    """First-form constraints in source units, equal ones of a chunk kept once."""
    return H.parse_constraints(H.extract_hints(part_chunks(spark, d)), ["chunk_id"]).select(
        "chunk_id", "parameter", "operator", "lower", "upper", "unit"
    )


@query(
    "spec_constraints",
    f"""WITH {PART_CHUNKS}
SELECT chunk_id, parameter, CASE WHEN k = 4 OR (k = 5 AND p_size = 0) THEN 'scalar' ELSE 'interval' END AS value_type,
  round(CASE WHEN k = 4 THEN norm_value END, 6) AS scalar_value, norm_unit AS unit,
  CASE scope0 WHEN 'national' THEN 100 WHEN 'industry' THEN 80 WHEN 'enterprise' THEN 60 WHEN 'reference' THEN 20 ELSE 40 END AS level,
  'active' AS lifecycle, true AS is_binding, p_brand AS source_doc, CASE WHEN scope0 = 'other' THEN 'project' ELSE scope0 END AS source_doc_type,
  'general' AS branch FROM ph""",
)
def spec_constraints(spark, d):
    """Typed constraints with priority, life cycle and source."""
    return C.build_constraints(part_chunks(spark, d), ["chunk_id"]).select(
        "chunk_id", "parameter", "value_type", rounded("scalar_value"), "unit", "level", "lifecycle", "is_binding", "source_doc",
        "source_doc_type", "branch",
    )


@query(
    "constraint_lineage",
    f"""WITH {PART_CHUNKS}
SELECT parameter, p_brand AS doc_id, chunk_id, p_name AS block FROM ph""",
)
def constraint_lineage(spark, d):
    """From a constraint back to its chunk, block and document."""
    chunks = part_chunks(spark, d)
    built = C.build_constraints(chunks, ["chunk_id"]).select("chunk_id", "parameter", "source_doc")
    return built.join(chunks.select("chunk_id", F.col("p_name").alias("block")), "chunk_id").select(
        "parameter", F.col("source_doc").alias("doc_id"), "chunk_id", "block"
    )


@query(
    "brand_solve",
    f"""WITH {PART_CHUNKS},
i AS (SELECT p_brand AS query_id, parameter, norm_unit AS unit,
   CASE k WHEN 1 THEN norm_value WHEN 3 THEN norm_value WHEN 5 THEN 0.1::DOUBLE END AS lower,
   CASE k WHEN 0 THEN norm_value WHEN 2 THEN norm_value WHEN 5 THEN (p_size + 10)::DOUBLE * 0.01::DOUBLE END AS upper, k <> 3 AS lower_inc
   FROM ph WHERE k <> 4),
k AS (SELECT query_id, parameter, max(lower) AS lo, min(upper) AS up, max(CASE WHEN NOT lower_inc THEN lower END) AS lo_open FROM i GROUP BY query_id, parameter),
r AS (SELECT query_id, parameter, 0 AS x, coalesce(lo > up OR (lo = up AND coalesce(lo_open = lo, false)), false) AS had_conflict, lo, up, lo_open FROM k)
SELECT query_id, parameter, had_conflict, round(CASE WHEN had_conflict OR coalesce(lo_open = lo, false) THEN NULL ELSE lo END, 6) AS range_lower,
  round(CASE WHEN NOT had_conflict THEN up END, 6) AS range_upper FROM r
UNION ALL SELECT p_brand, 'percentage', false, NULL, NULL FROM ph WHERE k = 4 GROUP BY p_brand""",
)
def brand_solve(spark, d):
    """Text to solved ranges in one plan, a query per brand; scalars leave no range."""
    rows = part_chunks(spark, d).withColumnRenamed("p_brand", "query_id")
    built = C.build_constraints(rows, ["query_id", "chunk_id"])
    best = C.dedup_constraints(built, ["query_id"], [F.col("chunk_id"), F.col("hint_ord")])
    ready = best.withColumns({"ord": F.col("chunk_id") * 100 + F.col("hint_ord"), "scope_path": F.lit(None).cast("array<string>")})
    return SO.solve_ranges(ready, ["query_id"]).select("query_id", "parameter", "had_conflict", rounded("range_lower"), rounded("range_upper"))


@query(
    "lifecycle_filter",
    f"""WITH {PART_CHUNKS}
SELECT p_type, count(*) AS n, count(*) FILTER (p_type <> 'PROMO' AND p_type <> 'SMALL') AS binding FROM ph GROUP BY p_type""",
)
def lifecycle_filter(spark, d):
    """Life cycle from text: small ones are under review, promo ones drafts; neither binds."""
    mark = F.when(F.col("p_type") == "PROMO", "（征求意见稿）").when(F.col("p_type") == "SMALL", "（审阅）").otherwise("")
    chunks = part_chunks(spark, d).withColumn("text", F.concat("text", mark))
    built = C.build_constraints(chunks, ["chunk_id", "p_type"])
    kept = A.binding_only(built).groupBy("p_type").agg(F.count(F.lit(1)).alias("binding"))
    return built.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).join(kept, "p_type", "left").select(
        "p_type", "n", F.coalesce("binding", F.lit(0)).alias("binding")
    )


@query(
    "clause_history",
    """SELECT p_brand || '-' || (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS scope, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS provision_id,
       count(*) AS versions FROM part GROUP BY 1, 2""",
)
def clause_history(spark, d):
    """Provision numbers found in scope segments, with their constraints counted (extension)."""
    number = F.concat((F.floor(F.col("p_size") / 10)).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    p = table(spark, d, "part").withColumn("scope", F.concat(F.regexp_replace("p_brand", "$", "-"), number))
    rows = p.withColumn("provision_id", S.provision_id(F.array(F.lit("x"), F.concat(F.lit("clause "), number)))).withColumn("version", F.col("p_partkey"))
    return A.clause_history(rows).groupBy("scope", "provision_id").agg(F.count(F.lit(1)).alias("versions"))


@query(
    "conditions_and_branch",
    """SELECT p_partkey AS part_id, CASE WHEN p_type = 'ECONOMY' THEN p_name ELSE 'general' END AS branch,
  CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS n_conditions FROM part""",
)
def conditions_and_branch(spark, d):
    """Applicability conditions and the branch they name."""
    name = F.translate("p_name", "sS\\", "zZ_")
    p = table(spark, d, "part").withColumn(
        "text", F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("在"), name, F.lit("环境下，温度不超过5°C"))).otherwise(F.lit("温度不超过5°C"))
    )
    conds = S.conditions(F.col("text"))
    return p.select(
        F.col("p_partkey").alias("part_id"),
        F.when(S.branch_key(conds) == name, F.col("p_name")).otherwise(S.branch_key(conds)).alias("branch"),
        F.size(conds).alias("n_conditions"),
    )


@query(
    "unit_normalize",
    """WITH u AS (SELECT event_id, value, CASE user_id % 8 WHEN 0 THEN 'mm' WHEN 1 THEN '°F' WHEN 2 THEN 'K' WHEN 3 THEN 'MPa' WHEN 4 THEN 'acre' WHEN 5 THEN '小时' WHEN 6 THEN '%' ELSE 'widget' END AS unit FROM events)
SELECT event_id, round(CASE unit WHEN 'mm' THEN value * 0.001::DOUBLE WHEN '°F' THEN (value - 32) * 5 / 9 WHEN 'K' THEN value - 273.15::DOUBLE WHEN 'MPa' THEN value * 1e6::DOUBLE
   WHEN 'acre' THEN value * 4046.86::DOUBLE WHEN '小时' THEN value * (1::DOUBLE / 24) ELSE value END, 9) AS value,
  CASE unit WHEN 'mm' THEN 'm' WHEN '°F' THEN '°C' WHEN 'K' THEN '°C' WHEN 'MPa' THEN 'pa' WHEN 'acre' THEN 'm2' WHEN '小时' THEN 'd' ELSE unit END AS unit,
  CASE unit WHEN 'mm' THEN 'length' WHEN '°F' THEN 'temperature' WHEN 'K' THEN 'temperature' WHEN 'MPa' THEN 'pressure' WHEN 'acre' THEN 'area'
    WHEN '小时' THEN 'time_duration' WHEN '%' THEN 'percentage' ELSE 'unknown' END AS category FROM u""",
)
def unit_normalize(spark, d):
    k = F.col("user_id") % 8
    unit = F.when(k == 0, "mm").when(k == 1, "°F").when(k == 2, "K").when(k == 3, "MPa").when(k == 4, "acre").when(k == 5, "小时").when(k == 6, "%").otherwise("widget")
    e = table(spark, d, "events").select("event_id", U.normalize_unit(F.col("value"), unit).alias("r"))
    return e.select("event_id", (F.round("r.value", 9) + 0.0).alias("value"), F.col("r.unit").alias("unit"), F.col("r.category").alias("category"))


@query(
    "unit_lookup_join",
    """SELECT event_id, round(CASE user_id % 3 WHEN 0 THEN value * 0.0254::DOUBLE WHEN 1 THEN value * 7 ELSE value END, 9) AS value,
  CASE user_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'd' ELSE 'furlong' END AS unit FROM events""",
)
def unit_lookup_join(spark, d):
    """The same conversion through the unit table, a fixed set of a few dozen rows."""
    k = F.col("user_id") % 3
    e = table(spark, d, "events").withColumn("unit", F.when(k == 0, "in").when(k == 1, "week").otherwise("furlong"))
    units = U.unit_table(spark).withColumnRenamed("unit", "unit_key")
    j = e.join(F.broadcast(units), F.lower("unit") == F.col("unit_key"), "left")
    return j.select("event_id", (F.round(F.col("value") * F.coalesce("factor", F.lit(1.0)), 9) + 0.0).alias("value"), F.coalesce("base", "unit").alias("unit"))


@query(
    "parameter_names",
    """SELECT p_partkey AS part_id, CASE p_partkey % 3 WHEN 0 THEN 'compressive_strength' WHEN 1 THEN lower(replace(p_name, ' ', '_')) ELSE 'temperature' END AS parameter FROM part""",
)
def parameter_names(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, " 抗压强度").when(k == 1, F.concat(F.col("p_name"), F.lit(" "))).otherwise("temp")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), U.normalize_parameter(raw).alias("parameter"))


@query(
    "deadlines",
    """SELECT p_partkey AS part_id, p_name AS reference_event,
  CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 7 WHEN 2 THEN p_size * 30 ELSE p_size END::BIGINT AS offset_days, p_partkey % 4 = 3 AS is_working_day FROM part""",
)
def deadlines(spark, d):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, "天").when(k == 1, "周").when(k == 2, "个月").otherwise("工作日")
    text = F.concat("p_name", F.when(k < 2, "后 ").otherwise("起"), F.col("p_size").cast("string"), unit, F.lit("内"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), U.parse_deadline(text).alias("r"))
    return p.select("part_id", "r.reference_event", "r.offset_days", "r.is_working_day")


@query(
    "priority_names",
    """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 80 WHEN '3-MEDIUM' THEN 60 WHEN '4-NOT SPECIFIED' THEN 40 END AS level FROM orders""",
)
def priority_names(spark, d):
    o = F.col("o_orderpriority")
    name = F.when(o == "1-URGENT", "NATIONAL").when(o == "2-HIGH", "80").when(o == "3-MEDIUM", "ENTERPRISE").when(o == "4-NOT SPECIFIED", "40").otherwise("whatever")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), U.priority_level(name).alias("level"))


@query(
    "number_texts",
    """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_extendedprice AS loose,
  CASE WHEN l_quantity = 50 THEN '[50.0]' WHEN l_linenumber % 2 = 0 THEN '(-inf,' || l_quantity::VARCHAR || ']' ELSE '(' || l_quantity::VARCHAR || ',+inf)' END AS interval_text FROM lineitem""",
)
def number_texts(spark, d):
    """Loose number reading and the text form of intervals."""
    q, none, n = F.col("l_quantity"), F.lit(None).cast("double"), F.col("l_linenumber")
    point, even = q == 50, n % 2 == 0
    lower = F.when(point, q).when(even, none).otherwise(q)
    upper = F.when(point, q).when(even, q).otherwise(none)
    loose = N.loose_number(F.concat(F.lit("about "), F.col("l_extendedprice").cast("decimal(20,2)").cast("string"), F.lit(" °C")))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), n.alias("line"), F.col("l_partkey").alias("part"), loose.alias("loose"),
        N.interval_text(lower, point, upper, F.lit(True)).alias("interval_text"),
    )


@query(
    "token_estimate",
    "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, regexp_matches(rtrim(text), '[^0-9]$') AS atomic FROM documents",
)
def token_estimate(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(t).cast("long").alias("tokens"), X.is_atomic(t).alias("atomic"))
