"""Structured Streaming forms. Each function builds or starts one query; checkpoints are the
caller's, on storage all executors share."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed as K
from ..functions import ids
from ..operators import audit as A
from ..operators import store as ST
from ..operators import tasks as TS
from ..session import cut_lineage, stored
from ..sources import files as FS
from ..sources.blocks import number_read_lines
from .committed import CommittedTable


def start_ingest(
    spark: SparkSession, bundle_dir: str, checkpoint: str, handle: Callable[[DataFrame, int], None], max_files: int = 1000
) -> StreamingQuery:
    """New bundle files in micro-batches, each handed over as block lines (bundle_id, line_no, value).

    The checkpoint makes progress exactly-once per file; the handler merges by version, so a
    batch that runs again changes nothing.
    """
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(bundle_dir)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("piece"),
            "value",
        )
    )

    def batch(df: DataFrame, epoch: int) -> None:
        # files are read once; a file of any size stays spread as it was read
        rows = stored(df.withColumn("seq", F.monotonically_increasing_id()), "ingest-lines")
        bundle = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("bundle_id")
        handle(number_read_lines(rows).select("file", "line_no", "value", bundle), epoch)

    return (
        lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_once(
    spark: SparkSession, bundle_dir: str, checkpoint: str, target: CommittedTable, chunks_of: Callable[[DataFrame], DataFrame], stream: str = "ingest",
    max_files: int = 1000, before_commit: Callable[[int], None] = lambda epoch: None,
) -> StreamingQuery:
    """Arriving bundles to stored chunks, exactly once: chunks_of(lines) of each batch goes into the table with its epoch."""

    def handle(lines: DataFrame, epoch: int) -> None:
        target.append(chunks_of(lines), stream, epoch, lambda: before_commit(epoch))

    return start_ingest(spark, bundle_dir, checkpoint, handle, max_files)


def newest_versions(chunks: DataFrame) -> DataFrame:
    """Chunks of the newest version of each document, once for equal keys, whatever order versions arrived in."""
    newest = chunks.groupBy("doc_hash").agg(F.max("version").alias("keep_version"))
    return ST.delete_old_versions(chunks, newest).dropDuplicates(["doc_hash", "version", "chunk_index"])


def unique_notices(notices: DataFrame, event_time: str, lateness: str = "1 day") -> DataFrame:
    """Notices by request_id, repeats within the lateness dropped."""
    keyed = notices.withColumn("request_id", ids.request_id(F.col("trace_id"), F.col("doc_hash"), F.col("version")))
    return keyed.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["request_id"])


def merge_versions(chunks: DataFrame, table: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Keep per document the newest version seen, whatever order versions arrive in.

    The table is `table/bucket=N`, by document. A batch reads and rewrites only the buckets of the documents it brings;
    the rows are kept on reliable storage before the old ones are replaced. A batch that runs again changes nothing.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("bucket", F.pmod(F.xxhash64("doc_hash"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
        if not touched:
            return
        try:
            stored = spark.read.schema(new.schema).parquet(table).where(F.col("bucket").isin(touched))
            new = stored.unionByName(new)
        except AnalysisException:  # the first batch
            pass
        keep = new.groupBy("doc_hash").agg(F.max("version").alias("keep_version"))
        merged = cut_lineage(ST.delete_old_versions(new, keep).dropDuplicates(["doc_hash", "version", "chunk_id"]))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Quota(StatefulProcessor):
    """Window start and count per key."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start double, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, seen = self.window.get() if self.window.exists() else (None, 0)
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            placed = []
            for t in pdf["ts"]:
                if start is None or t - start >= self.seconds:
                    start, seen = t, 0
                seen += 1
                placed.append((start, seen))
            out = pd.DataFrame(placed, columns=["window_start", "position"], index=pdf.index)
            yield pd.DataFrame(
                {
                    "key": key[0], "event_id": pdf["event_id"], "ts": pdf["ts"], "window_start": out["window_start"],
                    "position": out["position"], "allowed": out["position"] <= self.limit,
                }
            )
        self.window.update((float(start), int(seen)))

    def close(self) -> None:
        pass


QUOTA_SCHEMA = "key bigint, event_id bigint, ts double, window_start double, position bigint, allowed boolean"


def quota_flags(events: DataFrame, limit: int = K.QUOTA_EVENTS, seconds: float = K.QUOTA_SECONDS) -> DataFrame:
    """Events (key, event_id, ts seconds) flagged against a window anchored per key."""
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Quota(limit, seconds), outputStructType=QUOTA_SCHEMA, outputMode="Append", timeMode="None"
    )


def suppress_repeats(events: DataFrame, seconds: float = K.REPEAT_SECONDS) -> DataFrame:
    """At most one event per key and period."""
    return quota_flags(events, 1, seconds).where("allowed")


def start_retries(
    ticks: DataFrame, read: Callable[[], DataFrame], handler: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None],
    checkpoint: str, every: str = "60 seconds", max_attempts: int = K.MAX_ATTEMPTS, age: float = K.RETRY_AGE_SECONDS, once: bool = False,
) -> StreamingQuery:
    """On every tick the tasks that may be claimed go through the handler, and the new states are written.

    read: the task table. handler: claimed tasks -> request_id, ok, error; it runs once for each tick, and its results
    are kept before states are derived from them. write: states as of retry_scan, with the tick's number.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        tasks, now = read(), F.lit(time.time())
        claimed = tasks.where((F.col("unwired_skipped") == 0) & TS.claimable(now, max_attempts, age))
        results = cut_lineage(handler(claimed).select("request_id", F.col("ok").alias("_ok"), F.col("error").alias("_error")))
        rows = tasks.join(results, "request_id", "left")
        write(TS.retry_scan(rows, now, F.coalesce("_ok", F.lit(False)), F.col("_error"), max_attempts=max_attempts, age=age), epoch)

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def start_drift_checks(
    ticks: DataFrame, read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame], None],
    checkpoint: str, every: str = "5 minutes", migrating: Callable[[], bool] = lambda: False, once: bool = False,
) -> StreamingQuery:
    """Compare both stores on every tick and write the drift found, none while migrating."""

    def batch(df: DataFrame, epoch: int) -> None:
        full_text, vectors = read()
        found = ST.drift(full_text, vectors, migrating())
        write(found.where("drift_count > 0").withColumn("epoch", F.lit(epoch)))

    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def live_audit(lines: DataFrame) -> DataFrame:
    """Audit lines as they are written -> replay events, ready to append by date."""
    events = A.replay_events(FS.parse_audit(lines))
    return events.withColumn("date", F.substring("timestamp", 1, 10))


def fresh_encodings(encodings: DataFrame, texts: DataFrame, event_time: str, ttl: str = "24 hours") -> DataFrame:
    """Texts joined to encodings no older than the limit; state for older ones is dropped."""
    enc = encodings.withWatermark("encoded_at", ttl).select("cache_key", "vector", "encoded_at")
    txt = texts.withWatermark(event_time, "10 minutes")
    return txt.join(
        enc,
        (txt["cache_key"] == enc["cache_key"])
        & (enc["encoded_at"] <= txt[event_time])
        & (enc["encoded_at"] >= txt[event_time] - F.expr(f"INTERVAL {ttl}")),
        "leftOuter",
    ).drop(enc["cache_key"])


def metrics_over_time(
    events: DataFrame, event_time: str, labels: list[str], value: str, edges: list[float], window: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """Counters and cumulative latency buckets per window and label set."""
    cols: list[Column] = [F.count_if(F.col(value) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    return (
        events.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *labels)
        .agg(F.count(F.lit(1)).alias("total"), F.sum(value).alias("value_sum"), *cols)
        .select(F.col("window.start").alias("window_start"), *labels, "total", "value_sum", *[f"le_{i}" for i in range(len(edges))])
    )
