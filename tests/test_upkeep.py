"""Stores and streams that are kept up, sorted vectors, replay and operators by distance, against plain Python."""

import os
import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemesh.catalog import QUERIES
from clausemesh.functions import sparse as SV
from clausemesh.operators import encoding as EN
from clausemesh.operators import hints as H
from clausemesh.operators import inverted
from clausemesh.operators import replay as RP
from clausemesh.operators.inverted import InvertedIndex
from clausemesh.session import fresh_path, shared_dir
from clausemesh.streaming import jobs as J
from clausemesh.streaming import stateful as SF
from clausemesh.streaming.committed import CommittedTable


def test_index_writes_new_documents_only(spark):
    index = InvertedIndex(spark, fresh_path(spark, "index"))
    rows = lambda *texts: spark.createDataFrame([(f"{h}{i}", h, t) for h, i, t in texts], "chunk_id string, doc_hash string, text string")
    ask = lambda q: sorted(r.chunk_id for r in index.bm25(spark.createDataFrame([(1, q)], "query_id int, query string")).collect())
    index.update(rows(("a", 0, "red bolt"), ("a", 1, "blue bolt"), ("b", 0, "red nut")))
    before = {r.segment: r.n for r in index._read("postings", [1]).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert ask("red") == ["a0", "b0"] and ask("bol") == ["a0", "a1"] and ask("red -nut") == ["a0"] and ask("red-bo") == ["a0"]
    index.update(rows(("a", 0, "green washer")))  # the document has one chunk now
    sizes = {r.segment: r.n for r in index._read("postings", [1, 2]).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {**before, 2: 2}  # the first segment is as it was, the second holds the new terms alone
    assert ask("red") == ["b0"] and ask("bolt") == [] and ask("wash") == ["a0"]
    index.delete(rows(("b", 0, "")).select("doc_hash"))
    assert ask("red") == [] and index.chunks().count() == 1
    index.update(rows(("b", 0, "red again")))
    assert index.merge(1) == 1 and ask("red") == ["b0"] and ask("green") == ["a0"]
    number, segments, marks = index._manifest()
    assert len(segments) == 1 and marks == [] and index._read("postings", segments).count() == 4
    index.update(rows(("a", 0, "white")))
    assert ask("green") == [] and ask("white") == ["a0"]


def test_index_rows_are_not_moved(spark):
    """An update stores texts in the index alone, and the file of a chunk has all its rows; dead segments are not read."""
    index = InvertedIndex(spark, fresh_path(spark, "index"))
    here = lambda: {f for f in os.listdir(shared_dir(spark)) if f.startswith("index-words")}
    before = here()
    docs = spark.createDataFrame([(i, f"d{i % 3}", f"bolt{i} nut{i % 2} ring") for i in range(12)] + [(12, "d0", "")], "chunk_id long, doc_hash string, text string").repartition(3)
    index.update(docs.withColumn("text", F.lit("stale")))
    index.update(docs)
    assert here() == before
    files = index._read("rows", [2]).select("chunk_id", F.input_file_name().alias("f"), "term").groupBy("chunk_id").agg(F.count_distinct("f").alias("n"), F.count("term").alias("terms"))
    assert {(r.chunk_id, r.n, r.terms) for r in files.collect()} == {*((i, 1, 3) for i in range(12)), (12, 1, 0)}
    _, segments, marks = index._manifest()
    assert index._alive(segments, marks) == ([2], []) and index.chunks().count() == 13
    index.delete(docs.select("doc_hash").where("doc_hash = 'd1'"))
    _, segments, marks = index._manifest()
    assert index._alive(segments, marks) == ([], [2]) and index.chunks().count() == 9


def test_postings_are_columns_of_numbers(monkeypatch):
    """Terms and positions of whole Arrow batches, in parts of a few words, against plain Python; no row becomes a Python object."""
    monkeypatch.setattr(inverted, "CELLS", 7)
    texts = [(["a", "b", "a"], ["b"]), ([], []), ([], ["c"]), ([f"w{i % 4}" for i in range(20)], ["w1", "w1"])]
    cols = {"chunk_id": pa.array(range(4)), "tokens": pa.array([t for t, _ in texts], pa.list_(pa.string())), "scope_tokens": pa.array([s for _, s in texts], pa.list_(pa.string()))}
    batches = list(inverted._postings(iter([pa.RecordBatch.from_pydict(cols)] * 2 + [pa.RecordBatch.from_pydict(cols).slice(1, 1)])))
    got = sorted((r["chunk_id"], r["term"], r["positions"]) for b in batches for r in b.to_pylist())
    want = []
    for i, (t, s) in enumerate(texts):
        for w in {*t, *s}:
            want += [(i, w, [k for k, x in enumerate(t) if x == w] + [inverted.SCOPE_AT + k for k, x in enumerate(s) if x == w])] * 2
    assert got == sorted(want) and batches[0].schema.names == ["chunk_id", "term", "positions"]


class _Stream:
    """A query whose batches end one after the other; the first `busy` of them change state."""

    def __init__(self, busy, active=False):
        self.busy, self.n, self.isActive, self.status = busy, 0, True, {"isTriggerActive": active}

    @property
    def recentProgress(self):
        self.n += 1
        state = [SimpleNamespace(numRowsUpdated=int(i < self.busy), numRowsRemoved=0) for i in range(self.n)]
        return [SimpleNamespace(batchId=i, numInputRows=0, stateOperators=[o]) for i, o in enumerate(state)]

    def exception(self):
        return None

    def stop(self):
        self.isActive = False


def test_a_stream_that_goes_on_is_not_stopped():
    """Many batches that last longer than the limit together; one that does nothing more ends in an error."""
    long = _Stream(busy=40)
    SF.run_until(long, lambda: long.n >= 30, timeout=0.1, every=0.02)
    assert long.n == 30 and not long.isActive
    stuck = _Stream(busy=5)
    with pytest.raises(TimeoutError):
        SF.run_until(stuck, lambda: False, timeout=0.1, every=0.02)
    assert 5 < stuck.n < 20


class _Handle:
    """State and timers of one group, with the number of calls."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls, self.kept = self.calls + 1, value

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_retries_of_many_tasks_need_few_calls():
    """A group of tasks has one state and one timer; a task that is done meanwhile is not tried."""
    handle, tried = _Handle(), []
    retries = SF._Retries(lambda name, n: (tried.append((name, n)) or n >= 2, None), 3, 1.0)
    retries.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)
    frame = lambda *rows: pd.DataFrame(rows, columns=["request_id", "status", "attempts", "last_error", "updated_at", "unwired_skipped"])
    rows = [(f"t{i}", "PENDING", 0, None, 10.0 + i % 2, 0) for i in range(300)]
    assert list(retries.handleInputRows((0,), iter([frame(*rows)]), at(10_000))) == []
    assert handle.timers == [11_000] and handle.calls <= 4
    list(retries.handleInputRows((0,), iter([frame(("t0", "COMPLETED", 0, None, 10.5, 0), ("t1", "FAILED", 2, None, 5.0, 0))]), at(10_600)))  # the last is older

    def fire(ms):
        assert len(handle.timers) == 1 and handle.timers.pop() <= ms
        return pd.concat(list(retries.handleExpiredTimer((0,), at(ms), None)))

    first = fire(11_000)
    assert set(first["request_id"]) == {f"t{i}" for i in range(2, 300, 2)} and set(first["status"]) == {"FAILED"} and set(first["reason"]) == {"retry_invoked"}
    assert handle.timers == [12_000]  # both those tried just now and those due at first by then
    second = fire(12_000)
    assert len(second) == 299 and {(r.status, r.attempts) for r in second.itertuples()} == {("COMPLETED", 2), ("FAILED", 1)}
    third = fire(13_000)
    assert set(third["request_id"]) == {f"t{i}" for i in range(1, 300, 2)} and set(third["status"]) == {"COMPLETED"}
    assert handle.timers == [] and len(tried) == 598 and handle.calls < 20


def test_half_written_update_has_no_effect(spark):
    index = InvertedIndex(spark, fresh_path(spark, "index"))
    docs = spark.createDataFrame([("a0", "a", "red bolt")], "chunk_id string, doc_hash string, text string")
    index.update(docs)
    commit, index._commit = index._commit, lambda *_: (_ for _ in ()).throw(RuntimeError("crash"))
    with pytest.raises(RuntimeError):
        index.update(docs.withColumn("text", F.lit("blue")))
    index._commit = commit
    ask = lambda q: [r.chunk_id for r in index.bm25(spark.createDataFrame([(1, q)], "query_id int, query string")).collect()]
    assert ask("red") == ["a0"] and ask("blue") == []
    index.update(docs.withColumn("text", F.lit("green")))
    assert ask("red") == [] and ask("blue") == [] and ask("green") == ["a0"]


def test_batches_count_once(spark):
    table = CommittedTable(spark, fresh_path(spark, "table"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    got = lambda: sorted(r.i for r in table.read("i long").collect())

    def crash():
        raise RuntimeError("crash")

    assert got() == []
    assert table.append(rows(1, 2), "s", 0) and not table.append(rows(1, 2), "s", 0) and got() == [1, 2]
    with pytest.raises(RuntimeError):
        table.append(rows(3), "s", 1, crash)
    assert got() == [1, 2]
    assert table.append(rows(3), "s", 1) and table.append(rows(4), "other", 0) and got() == [1, 2, 3, 4]
    table.compact(lambda df: df.where("i <> 2"))
    assert got() == [1, 3, 4] and len(table.folders()) == 1
    assert not table.append(rows(1, 2), "s", 0) and table.append(rows(5), "s", 2) and got() == [1, 3, 4, 5]
    table.compact()
    assert got() == [1, 3, 4, 5] and not table.append(rows(4), "other", 0)


def test_newest_versions_count_in_any_order(spark):
    rows = [("d", 2, 0), ("d", 1, 0), ("d", 2, 1), ("d", 2, 1), ("e", 1, 0)]
    got = J.newest_versions(spark.createDataFrame(rows, "doc_hash string, version int, chunk_index long")).collect()
    assert sorted(map(tuple, got)) == [("d", 2, 0), ("d", 2, 1), ("e", 1, 0)]


def test_merge_dot(spark):
    rng = random.Random(2)
    vector = lambda n: [(rng.randint(-6, 6), rng.choice([0.5, -1.0, 2.0])) for _ in range(n)]
    rows = [(i, vector(rng.choice([0, 1, 5, 12])), vector(rng.choice([0, 1, 5, 12]))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<struct<index:long,value:double>>, b array<struct<index:long,value:double>>")
    a, b = SV.sorted_vector(F.col("a")), SV.sorted_vector(F.col("b"))
    for r in df.select("i", a.alias("x"), SV.merge_dot(a, b).alias("dot")).collect():
        one, two = {}, {}
        for into, entries in ((one, rows[r.i][1]), (two, rows[r.i][2])):
            for k, v in entries:
                into[k] = into.get(k, 0.0) + v
        assert r.x.indices == sorted(one) and r.x["values"] == [one[k] for k in sorted(one)]
        assert abs(r.dot - sum(v * two.get(k, 0.0) for k, v in one.items())) < 1e-12


def test_operators_by_distance(spark):
    texts = ["不超过50 mm, 不低于80 mm", "at least 3 mm", "30 mm to 40 mm", "x 5 mm y"]
    df = H.extract_hints(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string"))
    ops = lambda near: sorted((r.chunk_id, r.hint_ord, r.operator) for r in H.parse_operators(df, nearest=near).collect())
    assert [o for i, _, o in ops(True) if i == 0] == ["<=", ">="] and [o for i, _, o in ops(False) if i == 0] == ["<=", "<="]
    assert [x for x in ops(True) if x[0] in (1, 2)] == [x for x in ops(False) if x[0] in (1, 2)]
    assert not [x for x in ops(True) if x[0] == 3]


def test_digests_have_no_order(spark):
    rows = [(1, 0.1 + 0.2, [1.0, None]), (2, -0.0, None), (2, -0.0, None)]
    one = spark.createDataFrame(rows, "a int, b double, c array<double>")
    two = spark.createDataFrame([(r[2], r[0], r[1] + 1e-12) for r in reversed(rows)], "c array<double>, a int, b double").repartition(3)
    digest = lambda df: RP.result_digest(df).first()["digest"]
    assert digest(one) == digest(two) != digest(one.distinct())
    assert digest(one.limit(0)) != digest(one.limit(0).drop("a"))


def test_each_text_is_encoded_once(spark):
    texts = spark.createDataFrame([(i, f"text {i % 7}" if i % 5 else None) for i in range(50)], "id int, text string")
    stored = spark.createDataFrame([], "cache_key string, vector array<double>")
    new = EN.encode_missing(texts, stored, lambda ts: [[float(len(t))] for t in ts], F.lit("m"), batch=2)
    assert new.count() == 7 and new.groupBy("call").count().agg(F.max("count")).first()[0] <= 2
    rows = EN.encode_rows(texts, stored, new, F.lit("m")).collect()
    assert len(rows) == 50 and all((r.vector is None) == (r.text is None) for r in rows)
    path = os.path.join(fresh_path(spark, "vectors"))
    with pytest.raises(EN.DummyWrite):
        EN.store_encodings(new, path, dummy=True)
    EN.store_encodings(new, path, dummy=False)
    assert EN.encode_missing(texts, spark.read.parquet(path), lambda ts: 1 / 0, F.lit("m")).count() == 0


def test_both_operators_come_from_one_search_of_the_text(spark, sf):
    """No join of hints with themselves: the plan reads the parts once and shuffles nothing by a key."""
    plan = QUERIES["nearest_operators"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
