import json
import os
import pathlib
import random

from pyspark.sql import functions as F

from clausemesh.catalog import QUERIES
from clausemesh.operators import windows as WI
from clausemesh.session import fresh_path, shared_dir
from clausemesh.streaming import jobs as J


def expected(rows, seconds):
    state, out = {}, {}
    for k, e, t in sorted(rows, key=lambda r: (r[2], r[1])):
        start, n = state.get(k, (None, 0))
        start, n = (t, 1) if start is None or t - start >= seconds else (start, n + 1)
        state[k], out[e] = (start, n), (start, n)
    return out


def test_anchored_windows_with_a_hot_key(spark):
    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(9), i, float(rnd.randrange(0, 40_000))) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts double").repartition(4)
    for seconds in (5, 60, 900, 9000):
        got = {r.event_id: (r.window_start, r.position) for r in WI.anchored_windows(df, "key", F.col("ts"), "event_id", seconds).collect()}
        assert got == expected(rows, seconds)


def drain(spark, df, name):
    path = fresh_path(spark, name)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


def test_quota_stream_equals_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*")
    shape = lambda d: d.select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    got = drain(spark, J.quota_flags(shape(stream), 2, 36_000), "quota")
    want = WI.over_quota(shape(e), "key", F.col("ts"), "event_id", 2, 36_000)
    key = lambda d: sorted((r.event_id, r.position, r.allowed) for r in d.collect())
    assert key(got) == key(want)


def test_retries_call_the_handler(spark):
    """Three ticks: a task that works, one that works at the second attempt, one that never does, one set aside."""
    state = {
        k: {"request_id": k, "status": "FAILED", "attempts": 0, "last_error": None, "updated_at": 0.0, "unwired_skipped": int(k == "d")} for k in "abcd"
    }
    schema = "request_id string, status string, attempts int, last_error string, updated_at double, unwired_skipped int"
    calls, events = [], []

    def handler(claimed):
        names = sorted(r.request_id for r in claimed.collect())
        calls.append(names)
        return spark.createDataFrame([(k, k == "a" or (k == "c" and len(calls) > 1), "boom" if k == "b" else None) for k in names], "request_id string, ok boolean, error string")

    def write(rows, epoch):
        for r in rows.collect():
            events.append((r.request_id, r.status, r.reason))
            state[r.request_id] |= {k: r[k] for k in ("status", "attempts", "last_error", "updated_at", "unwired_skipped")}

    src = fresh_path(spark, "ticks")
    mark = fresh_path(spark, "retry")
    for i in range(3):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(src)
    ticks = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    read = lambda: spark.createDataFrame([tuple(v.values()) for v in state.values()], schema)
    J.start_retries(ticks, read, handler, write, mark, max_attempts=2, age=1, once=True).awaitTermination()
    assert calls == [["a", "b", "c"], ["b", "c"], []]
    assert [state[k]["status"] for k in "abcd"] == ["COMPLETED", "FAILED", "COMPLETED", "FAILED"]
    assert state["b"]["attempts"] == 2 and state["b"]["last_error"] == "boom | boom" and state["d"]["attempts"] == 0
    assert events[-1] == ("b", "FAILED", "claim_race_lost")


def test_versions_merge_in_any_order(spark):
    src = fresh_path(spark, "versions")
    schema = "doc_hash string, version int, chunk_id string"
    for rows in ([("d", 2, "c0"), ("e", 1, "c0")], [("d", 1, "c0")], [("d", 3, "c0"), ("d", 3, "c1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    table = fresh_path(spark, "store")
    J.merge_versions(stream, table, fresh_path(spark, "merge")).awaitTermination()
    rows = {(r.doc_hash, r.version, r.chunk_id) for r in spark.read.parquet(table).collect()}
    assert rows == {("d", 3, "c0"), ("d", 3, "c1"), ("e", 1, "c0")}


def test_bundles_stream_in(spark, tmp_path):
    for name in ("b1", "b2"):
        os.makedirs(tmp_path / name)
        with open(tmp_path / name / "data.jsonl", "w") as f:
            for i in range(3):
                f.write(json.dumps({"doc_id": name, "block_id": f"x{i}", "type": "text", "content": {"raw": f"line {i}"}}) + "\n")
    seen = []
    J.start_ingest(
        spark, str(tmp_path / "*" / "data.jsonl"), fresh_path(spark, "bundles"), lambda df, n: seen.extend((r.bundle_id, r.line_no) for r in df.collect())
    ).awaitTermination()
    assert sorted(seen) == [(b, i) for b in ("b1", "b2") for i in range(3)]


def test_one_large_file_stays_spread(spark, tmp_path):
    os.makedirs(tmp_path / "b1")
    (tmp_path / "b1" / "data.jsonl").write_text("".join(f"line {i}\n" for i in range(3000)))
    seen, key = [], "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        J.start_ingest(
            spark, str(tmp_path / "*" / "data.jsonl"), fresh_path(spark, "bundles"),
            lambda df, n: seen.extend(df.select("line_no", "value", F.spark_partition_id().alias("task")).collect()),
        ).awaitTermination()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.line_no, r.value) for r in seen) == [(i, f"line {i}") for i in range(3000)]
    assert len({r.task for r in seen}) > 1


def test_drift_ticks(spark):
    src, found = fresh_path(spark, "ticks"), []
    spark.range(1).write.parquet(src)
    ticks = spark.readStream.schema("id long").parquet(src)
    read = lambda: (spark.createDataFrame([("a", "active")], "chunk_id string, status string"), spark.createDataFrame([("a",), ("b",)], "chunk_id string"))
    J.start_drift_checks(ticks, read, lambda df: found.extend(df.collect()), fresh_path(spark, "ticks"), once=True).awaitTermination()
    assert [r.drift_count for r in found] == [1]
    found.clear()
    J.start_drift_checks(ticks, read, lambda df: found.extend(df.collect()), fresh_path(spark, "ticks"), migrating=lambda: True, once=True).awaitTermination()
    assert found == []


def test_stream_ingest_stores_compressed_files(spark, sf):
    """Arriving bundles lie in compressed files of the tasks that made them, each bundle's version in one; batches store lines as tables."""
    here = lambda name: {str(p) for p in pathlib.Path(shared_dir(spark)).glob(f"{name}-*")}
    before = {n: here(n) for n in ("bundles", "ingest-lines")}
    assert QUERIES["stream_ingest"](spark, sf).count() > 0
    (bundles,) = here("bundles") - before["bundles"]
    files = [p for p in pathlib.Path(bundles).rglob("*") if p.name.startswith("part-")]
    assert len(files) > 4 and all(p.name.endswith(".txt.gz") for p in files)
    row = F.from_json("value", "bundle_id string, version int")
    held = spark.read.text(bundles).select(row.alias("r"), F.input_file_name().alias("f")).groupBy("r").agg(F.count_distinct("f").alias("n"))
    assert held.agg(F.max("n")).first()[0] == 1
    assert len(here("ingest-lines") - before["ingest-lines"]) >= 4
