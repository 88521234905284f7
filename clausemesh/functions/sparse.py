"""Sparse vectors as two arrays in the order of the index, and their dot product by merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_index(term: Column) -> Column:
    """A whole number that stands for a term."""
    return F.xxhash64(term)


def sorted_vector(entries: Column) -> Column:
    """STRUCT<indices, values> from ARRAY<STRUCT<index, value>>: by index, values of one index added up."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(e["index"].cast("long").alias("index"), e["value"].cast("double").alias("value"))))
    empty = F.struct(F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<double>").alias("values"))

    def add(kept: Column, e: Column) -> Column:
        n = F.size(kept["indices"])
        again = (n > 0) & (F.get(kept["indices"], n - 1) == e["index"])
        last = F.get(kept["values"], n - 1) + e["value"]
        return F.struct(
            F.when(again, kept["indices"]).otherwise(F.concat(kept["indices"], F.array(e["index"]))).alias("indices"),
            F.when(again, F.concat(F.slice(kept["values"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(F.concat(kept["values"], F.array(e["value"]))).alias("values"),
        )

    return F.aggregate(ordered, empty, add)


def merge_dot(a: Column, b: Column) -> Column:
    """Dot product of two sorted vectors: one walk over both, which moves on where the smaller index is."""
    n, m = F.size(a["indices"]), F.size(b["indices"])
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("total"))

    def step(at: Column, _: Column) -> Column:
        x, y = F.get(a["indices"], at["i"]), F.get(b["indices"], at["j"])  # null behind the end
        both = F.coalesce(x == y, F.lit(False))
        first = F.coalesce(x <= y, x.isNotNull())
        second = F.coalesce(y <= x, y.isNotNull())
        product = F.get(a["values"], at["i"]) * F.get(b["values"], at["j"])
        return F.struct(
            (at["i"] + first.cast("int")).alias("i"), (at["j"] + second.cast("int")).alias("j"),
            F.when(both, at["total"] + product).otherwise(at["total"]).alias("total"),
        )

    return F.when((n > 0) & (m > 0), F.aggregate(F.sequence(F.lit(1), n + m), start, step, lambda at: at["total"])).otherwise(0.0)
