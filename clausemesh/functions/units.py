"""Unit conversion, parameter names and deadlines."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as K
from .text import strip


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def _unit_key(unit: Column) -> Column:
    return F.replace(F.lower(unit), F.lit("°"), F.lit(""))


def is_temperature(unit: Column) -> Column:
    return F.coalesce(_unit_key(unit).isin("c", "f", "k"), F.lit(False))


def to_celsius(value: Column, unit: Column, strict: bool = False) -> Column:
    """Affine conversion; an unsupported unit gives null, or fails when strict."""
    key = _unit_key(unit)
    known = (
        F.when(key == "c", value)
        .when(key == "f", (value - 32) * 5 / 9)
        .when(key == "k", value - 273.15)
    )
    if strict:
        return known.otherwise(
            F.raise_error(F.concat(F.lit("Unsupported temperature unit: "), unit)).cast("double")
        )
    return known


def _first_wins(pick) -> dict:
    table: dict = {}
    for category, (base, units) in K.UNIT_TABLE.items():
        for unit, factor in units.items():
            table.setdefault(unit, pick(category, base, factor))
    return table


def normalize_unit(value: Column, unit: Column) -> Column:
    """STRUCT<value, unit, category> in base units; an unknown unit passes through."""
    key = F.replace(_unit_key(unit), F.lit(" "), F.lit(""))
    factor = F.try_element_at(literal_map(_first_wins(lambda c, b, f: float(f))), key)
    base = F.try_element_at(literal_map(_first_wins(lambda c, b, f: b)), key)
    category = F.try_element_at(literal_map(_first_wins(lambda c, b, f: c)), key)
    hot = is_temperature(unit)
    return F.struct(
        F.when(hot, to_celsius(value, unit)).when(factor.isNotNull(), value * factor)
        .otherwise(value).alias("value"),
        F.when(hot, F.lit("°C")).otherwise(F.coalesce(base, unit)).alias("unit"),
        F.when(hot, F.lit("temperature")).otherwise(F.coalesce(category, F.lit("unknown")))
        .alias("category"),
    )


def unit_table(spark):
    """The conversion table as a DataFrame, for joins and for extending it."""
    rows = [
        (unit, float(factor), base, category, order)
        for order, (category, (base, units)) in enumerate(K.UNIT_TABLE.items())
        for unit, factor in units.items()
    ]
    return spark.createDataFrame(rows, "unit string, factor double, base string, category string, ord int")


def normalize_parameter(name: Column) -> Column:
    clean = strip(name)
    return F.coalesce(
        F.try_element_at(literal_map(K.PARAMETER_SYNONYMS), clean),
        F.replace(F.lower(clean), F.lit(" "), F.lit("_")),
    )


def parse_deadline(text: Column) -> Column:
    """STRUCT<reference_event, offset_days, is_working_day>, null without a deadline."""
    number = F.regexp_extract(text, K.DEADLINE, 2).cast("long")
    unit = F.regexp_extract(text, K.DEADLINE, 3)
    days = F.when(unit == "周", number * 7).when(unit == "个月", number * 30).otherwise(number)
    return F.when(
        text.rlike(K.DEADLINE),
        F.struct(
            strip(F.regexp_extract(text, K.DEADLINE, 1)).alias("reference_event"),
            days.alias("offset_days"),
            (unit == "工作日").alias("is_working_day"),
        ),
    )


def priority_level(value: Column) -> Column:
    """Level by enum name (upper case) or number; null where the value names none."""
    names = {k.upper(): v for k, v in K.PRIORITY_LEVEL.items()}
    number = F.try_to_number(value, F.lit("999")).cast("int")
    return F.coalesce(
        F.try_element_at(literal_map(names), value),
        F.when(number.isin(*K.PRIORITY_LEVEL.values()), number),
    )
