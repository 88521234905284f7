"""Ordered computations that stay balanced when one group holds most of the rows.

`first_rows` relies on row_number() <= k, for which Spark limits every group inside each
map task before the shuffle. `running` needs every row, so groups above a size limit are
range-partitioned by their order, summarised per partition, and given the value carried in
from the partitions before; no task ever holds a whole large group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 2_000_000


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The k first rows of every group in the given order."""
    name = rank or "_rank"
    window = W.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Groups above the size limit, or None. There are at most rows / hot_rows of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut_lineage(counts)
    return None if hot.isEmpty() else hot


def sorted_list(by: str, *fields: str, where: Column | None = None) -> Column:
    """Aggregate a group of bounded size, or its rows that fulfil `where`, to an array of structs ordered by one field."""
    row = F.struct(*fields)
    return sorted_by(by, F.collect_list(row if where is None else F.when(where, row)))


def sorted_by(by: str, rows: Column) -> Column:
    """An array of structs ordered by one field."""
    return F.array_sort(
        rows,
        lambda a, b: F.when(a.getField(by) < b.getField(by), -1).when(a.getField(by) > b.getField(by), 1).otherwise(0),
    )


@dataclass(frozen=True)
class Running:
    """One running value: 'max', 'min' or 'sum' of expr, with or without the current row."""

    fn: str
    expr: Column
    inclusive: bool = True


_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def _combine(fn: str, a: Column, b: Column) -> Column:
    if fn == "sum":
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return (F.greatest if fn == "max" else F.least)(a, b)


def _frames(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, Running]) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(*order)
    frame = {
        True: window.rowsBetween(W.unboundedPreceding, W.currentRow),
        False: window.rowsBetween(W.unboundedPreceding, -1),
    }
    return df.withColumns({n: _AGG[s.fn](s.expr).over(frame[s.inclusive]) for n, s in specs.items()})


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    specs: dict[str, Running],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running values per group. The order must be total within a group."""
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return _frames(df, keys, order, specs)
    match = _same(keys, df, hot)
    cold_part = _frames(df.join(hot, match, "left_anti"), keys, order, specs)
    rows = df.join(hot, match, "left_semi")
    total = hot.agg(F.sum("_n")).first()[0]
    parts = max(2, -(-int(total) // hot_rows))
    sort_keys = [F.col(k) for k in keys] + order
    rows = cut_lineage(
        rows.repartitionByRange(parts, *sort_keys).withColumn("_part", F.spark_partition_id())
    )
    local = _frames(rows, [*keys, "_part"], order, specs)
    totals = rows.groupBy(*keys, "_part").agg(*[_AGG[s.fn](s.expr).alias(n) for n, s in specs.items()])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        *[_AGG[s.fn](n).over(before).alias(f"_in_{n}") for n, s in specs.items()],
    )
    cond = F.col("_part") == F.col("_p")
    for i, key in enumerate(keys):
        cond = cond & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, cond, "left")
    hot_part = joined.select(
        *[c for c in df.columns],
        *[_combine(s.fn, F.col(f"_in_{n}"), F.col(n)).alias(n) for n, s in specs.items()],
    )
    return cold_part.unionByName(hot_part)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based position of every row within its group."""
    out = running(df, keys, order, {name: Running("sum", F.lit(1))}, hot_rows)
    return out.withColumn(name, F.col(name).cast("long"))
