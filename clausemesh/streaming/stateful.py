"""Streams with keyed state: retries on timers, encodings with a time to live, windows that count what comes too late."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed as K

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store; the setting holds for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


# --- retries -------------------------------------------------------------------------------------

Handler = Callable[[str, int], tuple[bool, str | None]]
RETRY_SCHEMA = "request_id string, status string, attempts int, last_error string, outcome string, reason string"


#: Groups that the tasks of a stream are dealt to. Calls to the state cost far more than the rows they carry.
RETRY_GROUPS = 1024
_KEPT = pa.schema([("request_id", pa.string()), ("status", pa.string()), ("attempts", pa.int32()), ("last_error", pa.string()), ("updated_at", pa.float64()), ("due", pa.int64())])


class _Retries(StatefulProcessor):
    """The tasks of a group with the time of their next attempts, in ms, and one timer for the first of these.

    `wake` is the time of that timer, 0 if there is none; `tasks` are Arrow rows of _KEPT, whose `due` is null where no
    attempt is waited for.
    """

    def __init__(self, handler: Handler, max_attempts: int, age: float):
        self.handler, self.max_attempts, self.age = handler, max_attempts, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "wake long, tasks binary")

    def _load(self) -> tuple[int, dict]:
        known = self.group.get()
        if known is None:
            return 0, {}
        with pa.ipc.open_stream(pa.py_buffer(bytes(known[1]))) as stored:
            columns = [c.to_pylist() for c in stored.read_all().columns]
        return known[0], dict(zip(columns[0], zip(*columns[1:])))

    def _keep(self, wake: int, tasks: dict) -> None:
        columns = [list(tasks), *zip(*tasks.values())]
        table, out = pa.table([pa.array(c, f.type) for c, f in zip(columns, _KEPT)], schema=_KEPT), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _KEPT) as stored:
            stored.write_table(table)
        self.group.update((wake, out.getvalue().to_pybytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The newest state of a task that arrives replaces the one kept, unless that is newer."""
        new = pd.concat(list(rows)).sort_values(["updated_at", "attempts"], kind="stable").drop_duplicates("request_id", keep="last")
        wake, tasks = self._load()
        soon, first = timerValues.getCurrentProcessingTimeInMs() + 1, None
        for name, status, attempts, error, at, unwired in zip(*(new[c].tolist() for c in ("request_id", "status", "attempts", "last_error", "updated_at", "unwired_skipped"))):
            if name in tasks and tasks[name][3] > at:
                continue
            due = None
            if status in K.RETRY_STATUSES and not unwired and attempts < self.max_attempts:
                due = max(int((at + self.age) * 1000), soon)
                first = due if first is None else min(first, due)
            tasks[name] = (status, int(attempts), error if isinstance(error, str) else None, float(at), due)
        if first is not None and (not wake or first < wake):  # a timer whose time has come stays: it goes off after the input
            if wake:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(first)
            wake = first
        self._keep(wake, tasks)
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, tasks = self._load()
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        now, out, wake = now_ms / 1000, [], 0
        for name, (status, attempts, last_error, _, due) in tasks.items():
            if due is not None and due <= now_ms:
                attempts, due = attempts + 1, None
                ok, error = self.handler(name, attempts)
                ok = ok and error is None
                if ok:
                    status, last_error = "COMPLETED", None
                else:
                    message = error or K.RETRY_FALSE_ERROR
                    status, last_error = "FAILED", f"{last_error} | {message}" if last_error else message
                    if attempts < self.max_attempts:
                        due = max(int((now + self.age) * 1000), now_ms + 1)
                tasks[name] = (status, attempts, last_error, now, due)
                out.append((name, status, attempts, last_error, "success" if ok else "failed", f"handler_failed:{error}" if error is not None else "retry_invoked"))
            if due is not None:
                wake = min(wake or due, due)
        if wake:
            self.handle.registerTimer(wake)
        self._keep(wake, tasks)
        if out:
            yield pd.DataFrame(out, columns=["request_id", "status", "attempts", "last_error", "outcome", "reason"])

    def close(self) -> None:
        pass


def timed_retries(
    tasks: DataFrame, handler: Handler, max_attempts: int = K.MAX_ATTEMPTS, age: float = K.RETRY_AGE_SECONDS, groups: int = RETRY_GROUPS
) -> DataFrame:
    """A row for every attempt at every task of a stream.

    tasks: request_id, status, attempts, last_error, updated_at (seconds), unwired_skipped; a task may arrive again with a
    newer state. A task that may be tried waits until it is `age` seconds old, and again after each failure. Tasks are kept
    in groups by their hash; a group is read when rows arrive for it or the first of its tasks is due, and no scan over all
    tasks is needed. A group's tasks are held in memory at once, so more of them want more groups, a number that may not
    change while a checkpoint is in use. handler(request_id, attempt) gives (ok, error). A micro-batch that runs again calls
    it again with the same attempt, so it should act once for each (request_id, attempt).
    """
    with_state(tasks.sparkSession)
    dealt = tasks.withColumn("_group", F.pmod(F.xxhash64("request_id"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=_Retries(handler, max_attempts, age), outputStructType=RETRY_SCHEMA, outputMode="Append", timeMode="ProcessingTime"
    )


def _moved(progress) -> bool:
    """Whether a batch read rows or changed state."""
    return progress.numInputRows > 0 or any(o.numRowsUpdated > 0 or o.numRowsRemoved > 0 for o in progress.stateOperators)


def run_until(query: StreamingQuery, done: Callable[[], bool], timeout: float = 300.0, every: float = 0.5) -> None:
    """Let a query run until done() and stop it: for streams whose timers fire after their input has ended.

    However long the stream takes, it may go on while its batches read rows or change state. It is an error if they do neither
    for `timeout` seconds, in which the time of a batch that is still at work does not count. done() is asked seldom if it is slow.
    """
    idle, last, seen = 0.0, time.time(), -1
    while query.isActive and idle < timeout:
        asked = time.time()
        if done():
            break
        time.sleep(max(every, 4 * (time.time() - asked)))
        new, now = [p for p in query.recentProgress if p.batchId > seen], time.time()
        if any(map(_moved, new)):
            idle = 0.0
        elif new or not query.status["isTriggerActive"]:
            idle += now - last
        last, seen = now, max([seen, *(p.batchId for p in new)])
    failed = query.exception()
    query.stop()
    if failed is not None:
        raise failed
    if not done():
        raise TimeoutError(f"the stream was not done, and nothing changed for {timeout} seconds")


# --- encodings -----------------------------------------------------------------------------------

Encoder = Callable[[list[str]], list[list[float]]]
ENCODING_SCHEMA = "cache_key string, id long, at double, encoded_at double, reused boolean, vector array<double>"


class _Encodings(StatefulProcessor):
    """The encoding of a key's text and when it was made."""

    def __init__(self, encoder: Encoder, seconds: float):
        self.encoder, self.seconds = encoder, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        # state that nobody asks for goes by itself; one that is asked for is judged by event time
        self.kept = handle.getValueState("encoding", "encoded_at double, vector array<double>", ttlDurationMs=max(1, int(self.seconds * 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"])
        made, vector = self.kept.get() if self.kept.exists() else (None, None)
        out, fresh = [], False
        for text, name, at in zip(frame["text"], frame["id"], frame["at"]):
            reused = made is not None and at - made <= self.seconds
            if not reused:
                made, vector, fresh = float(at), [float(x) for x in self.encoder([text])[0]], True
            out.append({"cache_key": key[0], "id": name, "at": at, "encoded_at": made, "reused": reused, "vector": list(vector)})
        if fresh:
            self.kept.update((made, list(vector)))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def encodings_with_ttl(texts: DataFrame, encoder: Encoder, seconds: float) -> DataFrame:
    """Every text (cache_key, id, text, at seconds) of a stream with an encoding that is at most `seconds` old at its time:
    the kept one of its key, or a new one where that is missing or stale."""
    with_state(texts.sparkSession)
    return texts.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=_Encodings(encoder, seconds), outputStructType=ENCODING_SCHEMA, outputMode="Append", timeMode="ProcessingTime"
    )


# --- windows -------------------------------------------------------------------------------------


class _Windows(StatefulProcessor):
    """Counts, sums and latency buckets of open windows by their start; a timer closes each at its end."""

    def __init__(self, edges: list[float], size_ms: int):
        self.edges, self.size = edges, size_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "total long, value_sum double, below array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            start = (frame["at_ms"] // self.size) * self.size
            for s, part in frame.groupby(start):
                known = self.open.containsKey((int(s),))
                total, value_sum, below = self.open.getValue((int(s),)) if known else (0, 0.0, [0] * len(self.edges))
                below = [int(b + (part["value"] <= e).sum()) for b, e in zip(below, self.edges)]
                self.open.updateValue((int(s),), (int(total + len(part)), float(value_sum + part["value"].sum()), below))
                if not known:
                    self.handle.registerTimer(int(s) + self.size)
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.size
        total, value_sum, below = self.open.getValue((start,))
        self.open.removeKey((start,))
        yield pd.DataFrame([{"label": key[0], "start_ms": start, "total": total, "value_sum": value_sum, "below": list(below)}])

    def close(self) -> None:
        pass


def closed_windows(events: DataFrame, event_time: str, label: str, value: str, edges: list[float], size: float, lateness: str) -> DataFrame:
    """label, start_ms, total, value_sum, below: the windows of `size` seconds of a stream as the watermark closes them.

    Rows at or behind the watermark are dropped before they reach the state, and the progress of the query counts them:
    see late_rows().
    """
    with_state(events.sparkSession)
    rows = events.withWatermark(event_time, lateness).select(
        F.col(label).cast("string").alias("label"), F.col(event_time), F.unix_millis(event_time).alias("at_ms"), F.col(value).cast("double").alias("value")
    )
    return rows.groupBy("label").transformWithStateInPandas(
        statefulProcessor=_Windows(edges, int(size * 1000)), outputMode="Append", timeMode="EventTime",
        outputStructType="label string, start_ms long, total long, value_sum double, below array<long>",
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late in the batches whose progress the query still holds."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
