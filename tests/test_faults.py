"""Cases that were wrong once."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemesh.operators import hints as H
from clausemesh.operators import retrieval as R
from clausemesh.operators import solving as SO
from clausemesh.operators import stats as SX
from clausemesh.operators import store as ST
from clausemesh.operators import tasks as TS
from clausemesh.operators import windows as WI
from clausemesh.plans import ingest as IN


def test_dense_topk_does_not_depend_on_batches(spark):
    """Scores 1e-10 apart count as equal and go by id, however the rows are split; equal vectors do not flood."""
    base = np.array([1.0, 0.0])
    near = lambda e: [float(np.cos(e)), float(np.sin(e))]
    rows = [(i, near(1e-6 * (10 - i))) for i in range(10)] + [(100 + i, [0.0, 1.0]) for i in range(50)] + [(900, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, base.tolist())], "query_id int, vector array<double>")
    got = {n: [r.chunk_id for r in R.dense_topk(queries, chunks.repartition(n), k=12).orderBy("rank").collect()] for n in (1, 2, 7)}
    assert got[1] == got[2] == got[7] == [*range(10), 100, 101]
    with pytest.raises(Exception, match="dimensions"):
        R.dense_topk(queries, spark.createDataFrame([(1, [1.0])], chunks.schema)).collect()


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_sparse_topk_by_hand(spark, monkeypatch, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    rng = np.random.default_rng(2)
    docs = [(i, [f"t{j}" for j in rng.integers(0, 12, 9)]) for i in range(60)] + [(98, []), (99, None)]
    terms = [(q, f"t{j}", float(j + 1)) for q in range(5) for j in range(q, q + 4)]
    got = R.sparse_topk(
        spark.createDataFrame(terms, "query_id int, term string, weight double"), spark.createDataFrame(docs, "chunk_id int, terms array<string>").repartition(3), k=8
    ).collect()
    want = set()
    for q in range(5):
        weight = {t: w for a, t, w in terms if a == q}
        scores = sorted((-sum(weight.get(t, 0) for t in ts), i) for i, ts in docs if ts and any(t in weight for t in ts))
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scores[:8])}
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got} == want


def test_literal_matches_inside_words(spark):
    q = spark.createDataFrame([(1, " ell "), (2, "..."), (3, " "), (4, "ell")], "query_id int, query string")
    c = spark.createDataFrame([(1, "hello..."), (2, None), (3, "")], "chunk_id int, text string")
    assert {(r.query_id, r.chunk_id) for r in R.literal_matches(q, c).collect()} == {(1, 1), (2, 1), (4, 1)}


def test_upsert_keeps_the_last_of_equal_new_keys(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "z", 3), (1, "y", 2), (3, "c", 1)], old.schema)
    assert {(r.k, r.v) for r in ST.upsert(old, new, ["k"], [F.col("n")]).collect()} == {(1, "z"), (2, "b"), (3, "c")}
    assert {(r.k, r.v) for r in ST.upsert(old, new.coalesce(1), ["k"]).collect()} == {(1, "y"), (2, "b"), (3, "c")}


def test_limited_migration_loses_nothing(spark, tmp_path):
    rows = [(f"d{i % 10:02d}", 1, f"c{i:03d}", f"t{i}", ["s"], [f"b{i}"]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "doc_hash string, version int, chunk_id string, text string, scope_path array<string>, source_block_ids array<string>")
    chunks = chunks.withColumns({"form_fields": F.lit(None).cast("array<map<string,string>>"), "column_headers": F.lit(None).cast("array<struct<index:int,header:string>>")})
    path = str(tmp_path / "store")
    ST.migrate_full_text(chunks, apply_to=path)
    torn = chunks.withColumn("text", F.when(F.col("chunk_id") != "c001", F.concat("text", F.lit("!"))))
    out = {r.doc_hash: (r.outcome, r.rows_written) for r in ST.migrate_full_text(torn, apply_to=path, limit=2).collect()}
    assert out == {"d00": ("migrated", 40), "d01": ("failed", 0)}
    stored = {r.chunk_id: r.text for r in spark.read.parquet(path).collect()}
    assert len(stored) == 400 and sum(t.endswith("!") for t in stored.values()) == 40


def test_snapshot_of_short_rows_reaches_the_limit(spark):
    rows = spark.range(3000).select(F.lit(1).alias("q"), F.col("id").alias("ord"), F.lit(None).cast("string").alias("p"))
    text = SO.lineage_snapshot(rows, ["q"], ["p"]).first().lineage_snapshot
    assert text.startswith('[{"p":null},') and len(text) > 4096


def test_percentiles_of_null_groups_and_infinities(spark):
    rows = [(None, float(i)) for i in range(1, 101)] + [("a", float("inf")), ("a", 1.0), ("a", 2.0), ("a", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p99, r.n) for r in SX.nearest_percentiles(df, ["g"], "v", [50, 99]).collect()}
    assert got == {None: (50.0, 99.0, 100), "a": (1.0, float("inf"), 4)}


def test_first_of_equal_notices(spark):
    n = spark.createDataFrame([("t", "d", 1, 5), ("t", "d", 1, 2), ("t", "e", 1, 9)], "trace_id string, doc_hash string, version int, at int")
    fresh, seen = TS.new_tasks(n, spark.createDataFrame([], "request_id string"), [F.col("at")])
    assert sorted(r["at"] for r in fresh.collect()) == [2, 9] and [r.duplicates for r in seen.collect()] == [1]


def test_ingest_with_several_stored_versions(spark):
    notices = spark.createDataFrame([("d", 2, "b1"), ("e", 1, "b2")], "doc_hash string, version int, bundle_id string")
    lines = spark.createDataFrame([], "bundle_id string, line_no long, value string")
    names = spark.createDataFrame([], "bundle_id string, file_name string")
    stored = spark.createDataFrame([("d", 1, 4), ("d", 2, 7)], "doc_hash string, version int, chunks_indexed long")
    got = {(r.doc_hash, r.rag_status, r.chunks_indexed) for r in IN.ingest(notices, lines, names, stored)[1].collect()}
    assert got == {("d", "success", 7), ("e", "failed", 0)}


def test_hints_of_many_numbers(spark):
    """A table of numbers takes a time that grows with its length, not with its square or worse."""
    took = {}
    for n in (400, 1600):
        text = " ".join(f"{i} mm" if i % 3 else f"{i}.5 MPa" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        start = time.perf_counter()
        rows = H.extract_hints(df).collect()
        took[n] = time.perf_counter() - start
        assert len(rows) == n and sorted(r.value for r in rows) == sorted(float(i) if i % 3 else i + 0.5 for i in range(n))
    assert took[1600] < 30


def test_one_key_holds_all_events(spark):
    rng = np.random.default_rng(0)
    times = np.sort(np.round(rng.exponential(7, 6000).cumsum(), 2))
    df = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate(times)], "key string, id long, ts double").repartition(3)
    got = {r.id: (r.window_start, r.position) for r in WI.anchored_windows(df, "key", F.col("ts"), "id", 60).collect()}
    start, n, want = None, 0, {}
    for i, t in enumerate(times):
        if start is None or t >= start + 60:
            start, n = t, 0
        n += 1
        want[i] = (start, n)
    assert len(got) == len(want)
    assert all(abs(got[i][0] - want[i][0]) < 1e-6 for i in want)
    by_time = {}
    for i, t in enumerate(times):
        by_time.setdefault(t, []).append(i)
    assert all(sorted(got[i][1] for i in ids) == sorted(want[i][1] for i in ids) for ids in by_time.values())
