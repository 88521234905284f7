"""Numbers with units in text, and the operators that turn them into intervals.

Offsets come from marking every match in the text and measuring the pieces between marks,
so all of it stays in JVM expressions. Texts without any candidate are dropped by one
pattern test before the per-pattern work starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import numbers as N
from ..functions import units as U
from .scan import first_rows

# private-use characters as marks; such characters in a text are replaced by another one
OPEN, CLOSE = chr(0xE000), chr(0xE001)
NO_MARKS = chr(0xE002) * 2


def unit_patterns(compat: bool = False) -> list[tuple[str, str]]:
    """compat reads '5cm' as 5 'c'; otherwise a temperature letter must end its word."""
    end = "" if compat else r"(?![A-Za-z])"
    return [
        (name, f"(?i){K.NUMBER}\\s*{unit}{end if name == 'temperature' else ''}")
        for name, unit in K.HINT_UNITS
    ]


def _matches(text: Column, category: str, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, category, source_text, value, unit>> of one pattern."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    # pieces alternate between text outside and inside the marks
    folded = F.aggregate(
        pieces,
        F.struct(
            F.lit(0).alias("at"),
            F.lit(False).alias("inside"),
            F.array().cast("array<struct<start:int,end:int,source_text:string>>").alias("out"),
        ),
        lambda acc, p: F.struct(
            (acc.at + F.length(p)).alias("at"),
            (~acc.inside).alias("inside"),
            F.when(
                acc.inside,
                F.concat(
                    acc.out,
                    F.array(
                        F.struct(acc.at.alias("start"), (acc.at + F.length(p)).alias("end"), p.alias("source_text"))
                    ),
                ),
            )
            .otherwise(acc.out)
            .alias("out"),
        ),
        lambda acc: acc.out,
    )
    return F.transform(
        F.when(text.rlike(pattern), folded).otherwise(F.array().cast("array<struct<start:int,end:int,source_text:string>>")),
        lambda m: F.struct(
            m.start.alias("start"),
            m.end.alias("end"),
            F.lit(category).alias("category"),
            m.source_text.alias("source_text"),
            N.to_double(F.regexp_extract(m.source_text, pattern, 1)).alias("value"),
            F.regexp_extract(m.source_text, pattern, 2).alias("unit"),
        ),
    )


def _context_parameter(text: Column, start: Column) -> Column:
    back = F.least(start, F.lit(K.CONTEXT_LOOKBACK))
    before = F.substr(text, start - back + 1, back)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in K.CONTEXT_WORDS:
        chain = chain.when(before.rlike(f"(?i){pattern}"), F.lit(name))
    return chain


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hint_array(text: Column, compat: bool = False) -> Column:
    """All hints of a text in pattern order; an earlier pattern owns its characters."""
    patterns = unit_patterns(compat)

    def of(clean: Column) -> Column:
        def after(taken: Column, rest: list[tuple[str, str]]) -> Column:
            if not rest:
                return taken
            free = F.filter(_matches(clean, *rest[0]), lambda m: ~F.exists(taken, lambda t: (t.start < m.end) & (m.start < t.end)))
            return _bound(F.concat(taken, free), lambda more: after(more, rest[1:]))

        found = _bound(_matches(clean, *patterns[0]), lambda first: after(first, patterns[1:]))
        return F.transform(
            found,
            lambda m, i: F.struct(
                i.alias("hint_ord"),
                F.coalesce(_context_parameter(clean, m.start), m.category).alias("parameter_hint"),
                m.value.alias("value"),
                m.unit.alias("unit"),
                m.start.alias("start"),
                m.end.alias("end"),
                m.source_text.alias("source_text"),
            ),
        )

    return _bound(F.translate(text, OPEN + CLOSE, NO_MARKS), of)


def has_candidate(text: Column) -> Column:
    return text.rlike(f"(?i){K.NUMBER}\\s*(?:{'|'.join(unit for _, unit in K.HINT_UNITS)})")


def extract_hints(chunks: DataFrame, text: str = "text", compat: bool = False) -> DataFrame:
    """One row per hint, next to the chunk's own columns.

    The outer generator keeps the optimizer from computing the array a second time for an
    inferred filter.
    """
    found = chunks.where(has_candidate(F.col(text))).select("*", F.inline_outer(hint_array(F.col(text), compat)))
    return found.where(F.col("hint_ord").isNotNull())


# --- operator near a number ----------------------------------------------------------


def _context(text: Column, start: Column, end: Column) -> Column:
    left = F.greatest(start - K.OPERATOR_RADIUS, F.lit(0))
    right = F.least(end + K.OPERATOR_RADIUS, F.length(text))
    return F.substr(text, left + 1, right - left)


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({K.SIGNED_NUMBER})"), F.lit(1)), N.to_double)


def range_endpoints(context: Column, value: Column) -> Column:
    """STRUCT<lower, upper>: the closest number on each side of the first usable range word."""
    segments = F.transform(F.split(context, K.RANGE_WORDS), _numbers)
    first = F.get(
        F.filter(
            F.transform(segments, lambda ns, i: F.when(F.size(ns) > 0, i)), lambda i: i.isNotNull()
        ),
        F.lit(0),
    )
    left = F.get(segments, first)
    right = F.flatten(F.slice(segments, first + 2, F.size(segments)))
    closest = lambda ns: F.array_min(
        F.transform(ns, lambda n: F.struct(F.abs(n - value).alias("d"), n.alias("n")))
    ).getField("n")
    usable = (first + 1 < F.size(segments)) & (F.size(right) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), F.struct(closest(left).alias("lower"), closest(right).alias("upper")))


def find_operator(context: Column, value: Column) -> Column:
    """STRUCT<operator, lower, upper>: first operator in list order that applies, else null."""
    ends = range_endpoints(context, value)
    pieces = F.split(context, K.SIGNED_NUMBER)
    nums = _numbers(context)
    hit = F.array_position(F.transform(nums, lambda n: F.abs(n - value) < 0.001), F.lit(True)).cast("int")
    gaps = F.transform(F.slice(pieces, F.lit(1), hit), F.length)
    raw = F.regexp_extract_all(context, F.lit(f"({K.SIGNED_NUMBER})"), F.lit(1))
    before_nums = F.transform(F.slice(raw, F.lit(1), hit - 1), F.length)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    value_at = F.when(hit > 0, total(gaps) + total(before_nums))
    chain = F.when(ends.isNotNull() & context.rlike(K.RANGE_WORDS), F.struct(
        F.lit("range").alias("operator"), ends.getField("lower").alias("lower"), ends.getField("upper").alias("upper")))
    verbs = f"(?s)^({'|'.join(K.MEASURING_VERBS)}).{{0,3}}$"
    none = F.lit(None).cast("double")
    for op, pattern in K.OPERATOR_WORDS:
        ok = context.rlike(pattern)
        if op == "==":
            before = F.get(F.split(context, pattern, 2), F.lit(0))
            ok = ok & (value_at.isNull() | (F.length(before) < value_at)) & ~before.rlike(verbs)
        chain = chain.when(
            ok, F.struct(F.lit(op).alias("operator"), none.alias("lower"), none.alias("upper"))
        )
    return chain


def _spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end>> of all matches of a pattern."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    start = lambda i: total(F.slice(pieces, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i))
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end")))


def nearest_operator(context: Column, value: Column, start: Column, end: Column) -> Column:
    """STRUCT<operator, lower, upper>: the operator with the fewest characters between it and the number at start .. end
    of the context, ties by list order, or null. A range word that has a number on both sides comes before others at its
    distance; '==' must stand before the number and not behind a measuring verb."""
    ends = range_endpoints(context, value)
    none = F.lit(None).cast("double")
    verbs = f"(?s)^({'|'.join(K.MEASURING_VERBS)}).{{0,3}}$"

    def candidates(order: int, op: str, pattern: str) -> Column:
        spans = _spans(context, pattern)
        if op == "range":
            spans = F.when(ends.isNotNull(), spans).otherwise(F.slice(spans, 1, 0))
        if op == "==":
            spans = F.filter(spans, lambda s: (s["end"] <= start) & ~F.substr(context, F.lit(1), s["start"]).rlike(verbs))
        return F.transform(
            spans,
            lambda s: F.struct(
                F.greatest(s["start"] - end, start - s["end"], F.lit(0)).alias("gap"), F.lit(order).alias("order"), F.lit(op).alias("operator"),
                (ends.getField("lower") if op == "range" else none).alias("lower"), (ends.getField("upper") if op == "range" else none).alias("upper"),
            ),
        )

    every = [candidates(-1, "range", K.RANGE_WORDS), *[candidates(i, op, p) for i, (op, p) in enumerate(K.OPERATOR_WORDS)]]
    best = F.array_min(F.concat(*every))
    return F.when(best.isNotNull(), F.struct(best["operator"].alias("operator"), best["lower"].alias("lower"), best["upper"].alias("upper")))


def _with_operator(hints: DataFrame, text: str, nearest: bool = False) -> DataFrame:
    """Hints with their operator as `op`; the context is cut once and bound in a lambda."""
    context = _context(F.col(text), F.col("start"), F.col("end"))
    at = F.least(F.col("start"), F.lit(K.OPERATOR_RADIUS))  # where the number begins in its context
    of = lambda c: nearest_operator(c, F.col("value"), at, at + F.col("end") - F.col("start"))
    op = F.transform(F.array(context), of if nearest else lambda c: find_operator(c, F.col("value")))
    return hints.select("*", F.explode_outer(op).alias("op")).where(F.col("op").isNotNull())


def to_interval(operator: Column, value: Column, lower: Column, upper: Column) -> Column:
    """STRUCT<lower, upper, lower_inclusive, upper_inclusive>; a missing bound is null."""
    none = F.lit(None).cast("double")
    return F.when(
        operator.isin("range", "<", ">", "<=", ">=", "=="),
        F.struct(
            F.when(operator == "range", lower).when(operator.isin(">", ">=", "=="), value).otherwise(none).alias("lower"),
            F.when(operator == "range", upper).when(operator.isin("<", "<=", "=="), value).otherwise(none).alias("upper"),
            (operator != ">").alias("lower_inclusive"),
            (operator != "<").alias("upper_inclusive"),
        ),
    )


def parse_operators(hints: DataFrame, text: str = "text", compat: bool = False, nearest: bool = False) -> DataFrame:
    """Hints with an operator: adds operator, norm_value, norm_unit and interval.

    compat leaves range endpoints of non-temperature units unconverted. nearest takes the operator closest to the number
    instead of the first in list order.
    """
    found = _with_operator(hints, text, nearest)
    norm = U.normalize_unit(F.col("value"), F.col("unit"))

    def bound(name: str) -> Column:
        raw = F.col(f"op.{name}")
        converted = U.normalize_unit(raw, F.col("unit")).getField("value")
        return F.when(U.is_temperature(F.col("unit")), converted).otherwise(raw) if compat else converted

    return found.withColumns(
        {"operator": F.col("op.operator"), "norm_value": norm.getField("value"), "norm_unit": norm.getField("unit")}
    ).withColumn(
        "interval", to_interval(F.col("operator"), F.col("norm_value"), bound("lower"), bound("upper"))
    ).drop("op")


def parse_intervals(hints: DataFrame, chunk: list[str], text: str = "text", compat: bool = False, nearest: bool = False) -> DataFrame:
    """Intervals of a chunk, the first of equal (parameter_hint, bounds, unit) kept."""
    parsed = parse_operators(hints, text, compat, nearest).withColumns(
        {"_lo": F.col("interval.lower"), "_up": F.col("interval.upper")}
    )
    return first_rows(parsed, [*chunk, "parameter_hint", "_lo", "_up", "norm_unit"], [F.col("hint_ord")]).drop("_lo", "_up")


def parse_constraints(hints: DataFrame, chunk: list[str], text: str = "text", nearest: bool = False) -> DataFrame:
    """First-form constraints: parameter, operator, value or range in the source unit, unit."""
    found = _with_operator(hints, text, nearest)
    rows = found.select(
        *[c for c in hints.columns if c not in ("value", "unit")],
        U.normalize_parameter(F.col("parameter_hint")).alias("parameter"),
        F.col("op.operator").alias("operator"),
        F.coalesce("op.lower", "value").alias("lower"),
        F.coalesce("op.upper", "value").alias("upper"),
        "unit",
    )
    return first_rows(rows, [*chunk, "parameter", "operator", "lower", "upper", "unit"], [F.col("hint_ord")])
