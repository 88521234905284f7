"""Windows anchored at events: a window opens at a key's first event and the next one at the
first event at least `seconds` later.

Events are range-partitioned by key and time, and a key's events in one partition are a unit,
so a key of any number of events is spread over tasks and has at most as many units as there
are partitions. A unit maps the earliest time a new window may open to that time after the
unit; the map is a short step function, since different entries soon meet the same window.
Units are tabulated in parallel and only the step functions are composed in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..session import cut_lineage


def _next_start(ts: np.ndarray, seconds: float) -> np.ndarray:
    return np.searchsorted(ts, ts + seconds, side="left")


def step_table_udf(seconds: float):
    """Per unit: entry times up to which a first start applies, and the state it leads to."""

    @F.pandas_udf("struct<cut array<double>, opens array<double>, seen array<bigint>>")
    def table(times: pd.Series) -> pd.DataFrame:
        cuts, opens, seen = [], [], []
        for t in times:
            ts = np.asarray(t, dtype=np.float64)
            n = len(ts)
            follow = _next_start(ts, seconds)
            last = np.arange(n)
            jump = follow.copy()
            # the last window start reached from each event, by doubling
            while True:
                inside = jump < n
                if not inside.any():
                    break
                target = np.where(inside, jump, 0)
                last = np.where(inside, last[target], last)
                jump = np.where(inside, jump[target], n)
            ends = ts[last]
            keep = np.append(ends[1:] != ends[:-1], True)
            # events sharing a time share the first of them as start
            cuts.append(ts[keep])
            opens.append(ends[keep] + seconds)
            first = np.searchsorted(ts, ends, side="left")
            seen.append((n - first)[keep])
        return pd.DataFrame({"cut": cuts, "opens": opens, "seen": seen})

    return table


def positions_udf(seconds: float):
    """Window start and position in the window for each event, given the state before the unit."""

    @F.pandas_udf("struct<start array<double>, position array<bigint>>")
    def place(times: pd.Series, opens: pd.Series, seen: pd.Series) -> pd.DataFrame:
        starts, places = [], []
        for t, o, s in zip(times, opens, seen):
            ts = np.asarray(t, dtype=np.float64)
            n = len(ts)
            start, position = np.empty(n), np.empty(n, dtype=np.int64)
            at = 0 if o is None or np.isnan(o) else int(np.searchsorted(ts, o, side="left"))
            if at:
                start[:at] = o - seconds
                position[:at] = np.arange(1, at + 1) + int(s)
            while at < n:
                end = int(np.searchsorted(ts, ts[at] + seconds, side="left"))
                start[at:end] = ts[at]
                position[at:end] = np.arange(1, end - at + 1)
                at = end
            starts.append(start)
            places.append(position)
        return pd.DataFrame({"start": starts, "position": places})

    return place.asNondeterministic()


def anchored_windows(events: DataFrame, key: str, ts: Column, ord_: str, seconds: float) -> DataFrame:
    """key, event, ts, window_start and 1-based position in the window, for every event."""
    base = events.select(key, F.col(ord_), ts.cast("double").alias("_ts")).repartitionByRange(key, "_ts")
    base = cut_lineage(base.withColumn("_u", F.spark_partition_id().cast("long")))  # units have to stay as they are
    units = base.groupBy(key, "_u").agg(F.sort_array(F.collect_list(F.struct("_ts", ord_))).alias("es"))
    tables = units.select(key, "_u", F.size("es").alias("n"), step_table_udf(seconds)(F.col("es._ts")).alias("t"))
    step = lambda acc, u: F.get(
        F.filter(F.arrays_zip(u.t.cut, u.t.opens, u.t.seen), lambda z: acc.opens.isNull() | (z.cut >= acc.opens)), F.lit(0)
    )
    walked = (
        tables.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_u", "n", "t"))).alias("us"))
        .select(
            key,
            F.explode(
                F.aggregate(
                    "us",
                    F.struct(
                        F.lit(None).cast("double").alias("opens"), F.lit(0).cast("long").alias("seen"),
                        F.array().cast("array<struct<_u:bigint,opens:double,seen:bigint>>").alias("out"),
                    ),
                    lambda acc, u: F.struct(
                        F.coalesce(step(acc, u).getField("opens"), acc.opens).alias("opens"),
                        F.coalesce(step(acc, u).getField("seen"), acc.seen + u.n).alias("seen"),
                        F.concat(acc.out, F.array(F.struct(u["_u"].alias("_u"), acc.opens.alias("opens"), acc.seen.alias("seen")))).alias("out"),
                    ),
                    lambda acc: acc.out,
                )
            ).alias("s"),
        )
        .select(key, "s.*")
    )
    placed = units.join(walked, [key, "_u"]).withColumn("p", positions_udf(seconds)(F.col("es._ts"), "opens", "seen"))
    rows = F.arrays_zip("es", "p.start", "p.position")
    return placed.select(key, F.explode_outer(rows).alias("r")).select(
        key, F.col(f"r.es.{ord_}").alias(ord_), F.col("r.es._ts").alias("ts"), F.col("r.start").alias("window_start"),
        F.col("r.position").alias("position"),
    )


def over_quota(events: DataFrame, key: str, ts: Column, ord_: str, limit: int = K.QUOTA_EVENTS, seconds: int = K.QUOTA_SECONDS) -> DataFrame:
    """Events with allowed flag; a refused event tells the seconds until its window ends (at least 1)."""
    placed = anchored_windows(events, key, ts, ord_, seconds)
    wait = F.greatest(F.lit(1), F.lit(seconds) - F.floor(F.col("ts") - F.col("window_start"))).cast("long")
    allowed = F.col("position") <= limit
    return placed.withColumns({"allowed": allowed, "retry_after": F.when(~allowed, wait)})


def without_repeats(events: DataFrame, key: str, ts: Column, ord_: str, seconds: float = K.REPEAT_SECONDS) -> DataFrame:
    """Events let through when each key may speak once per period."""
    return anchored_windows(events, key, ts, ord_, seconds).where("position = 1")
