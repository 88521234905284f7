"""Number parsing and the text form of intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "".join(chr(0xFF10 + d) for d in range(10))


def to_double(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, "0123456789").try_cast("double")


def loose_number(text: Column) -> Column:
    """Everything but digits, dots and minus signs removed, then read as a number."""
    return to_double(F.regexp_replace(text, r"[^\p{Nd}.\-]", ""))


def plain_double(value: Column) -> Column:
    """Decimal text of a double without an exponent between 1e-4 and 1e16."""
    text = value.cast("string")
    size = F.abs(value)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.replace(F.regexp_extract(text, r"^-?([\d.]+)E", 1), F.lit("."), F.lit(""))
    moved = F.concat(
        F.rpad(F.substr(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")),
        F.lit("."),
        F.coalesce(F.nullif(F.regexp_replace(F.substr(digits, exponent + 2), "0+$", ""), F.lit("")), F.lit("0")),
    )
    small = F.concat(
        F.lit("0."), F.repeat(F.lit("0"), F.abs(exponent) - 1), F.regexp_replace(digits, "0+$", "")
    )
    return (
        F.when(exponent.isNull(), text)
        .when((exponent > 0) & (size < 1e16), F.concat(sign, moved))
        .when((exponent < 0) & (size >= 1e-4), F.concat(sign, small))
        .otherwise(F.replace(F.lower(text), F.lit(".0e"), F.lit("e")))
    )


def interval_text(lower: Column, lower_inc: Column, upper: Column, upper_inc: Column) -> Column:
    """[a,b], (a,b], ... with -inf / +inf for open ends and [a] for one point."""
    left = F.when(lower.isNull(), F.lit("(-inf")).otherwise(
        F.concat(F.when(lower_inc, F.lit("[")).otherwise(F.lit("(")), plain_double(lower))
    )
    right = F.when(upper.isNull(), F.lit("+inf)")).otherwise(
        F.concat(plain_double(upper), F.when(upper_inc, F.lit("]")).otherwise(F.lit(")")))
    )
    point = F.coalesce((lower == upper) & lower_inc & upper_inc, F.lit(False))
    return F.when(point, F.concat(F.lit("["), plain_double(lower), F.lit("]"))).otherwise(
        F.concat(left, F.lit(","), right)
    )
