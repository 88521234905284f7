import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausemesh.operators import retrieval as R
from clausemesh.session import fresh_path


def test_rrf_example(spark):
    rows = [(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "c", 3), (1, 0, "b", 4), (1, 1, "b", 1), (1, 1, "d", 2)]
    lists = spark.createDataFrame(rows, "query_id int, list_id int, key string, pos int")
    got = {r.key: r.score for r in R.rrf(lists).collect()}
    assert max(got, key=got.get) == "b" and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12
    s = R.fusion_stats(lists).first()
    assert (s.vector_hits, s.fts_hits, s.both_hits) == (2, 1, 1)
    assert R.rrf(lists, k=0).count() == 0


def test_dense_topk_over_several_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors, queries = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    mk = lambda a, k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], f"{k} long, vector array<double>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 16)
    got = R.dense_topk(mk(queries, "query_id"), mk(vectors, "chunk_id").repartition(3), 7).collect()
    sims = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T
    want = {(q, int(c)) for q in range(40) for c in np.argsort(-sims[q])[:7]}
    assert {(r.query_id, r.chunk_id) for r in got} == want


def test_sparse_scores_of_common_words_are_made_in_parts(spark, monkeypatch):
    """500 words that all of 200 queries and 100 chunks have: 10 million (word, query) pairs, never held at once."""
    words, tasks = [f"w{i}" for i in range(500)], []
    kind = type(spark.range(1))
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, fn, schema: tasks.append(fn) or whole(self, fn, schema))
    terms = spark.range(200).select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, words))).alias("term"), (F.col("id") % 3 + 1.0).alias("weight"))
    chunks = spark.range(100).select(F.col("id").alias("chunk_id"), F.array(*map(F.lit, words + words[:1])).alias("terms"))
    R.sparse_topk(terms, chunks, 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([words + words[:1]] * 100)], names=["chunk_id", "terms"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(tasks[0](iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 600 and all(r["chunk_id"] < 3 and r["score"] == 501.0 * (r["query_id"] % 3 + 1) for r in found.to_pylist())
    assert peak < 200e6


DOCS = [
    (1, "pump A312-TP316 flange", ["national"], "active"), (2, "pump flange flange", ["project"], "active"), (3, "valve tp316", ["national"], "active"),
    (4, "Pümp station", ["industry"], "active"), (5, "pump flange", ["national"], "illegal"), (6, "a312 pump tp31", ["x"], "active"),
]


@pytest.mark.parametrize("in_row", [20_000, 0])
def test_bm25_by_hand(spark, monkeypatch, in_row):
    """Both ways of finding candidates: wanted terms looked up in the row, and joined."""
    monkeypatch.setattr(R, "IN_ROW_PHRASES", in_row)
    corpus = spark.createDataFrame(DOCS, "chunk_id int, text string, scope_path array<string>, status string")
    qs = spark.createDataFrame([(1, "pump flan"), (2, "a312-tp316"), (3, "pump -flange"), (4, "-pump")], "query_id int, query string")
    got = R.bm25_topk(qs, corpus).collect()
    hits = {}
    for r in got:
        hits.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert set(hits[1]) == {1, 2} and set(hits[2]) == {1} and set(hits[3]) == {4, 6} and 4 not in hits
    length = {1: 5, 2: 4, 3: 3, 4: 3, 5: 3, 6: 4}
    avg = sum(length.values()) / 6
    idf = lambda n: max(math.log((6 - n + 0.5) / (n + 0.5)), 1e-6)
    part = lambda n, tf, d: idf(n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[d] / avg))
    s = part(5, 1, 2) + part(3, 2, 2)
    assert abs(hits[1][2] - max(s / (1 + s), 0.01)) < 1e-9


def test_short_circuit_scope_and_rerank(spark):
    chunks = spark.createDataFrame(
        [("c1", "temp 80", ["national"], None), ("c2", "exact phrase here", ["project"], None), ("c3", "other", [], None)],
        "chunk_id string, text string, scope_path array<string>, doc_type string",
    ).withColumns(
        {"doc_hash": F.lit("d"), "form_fields": F.array().cast("array<map<string,string>>"), "column_headers": F.array().cast("array<struct<index:int,header:string>>")}
    )
    hit = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")
    vec, fts = hit([(1, "c1", 0.9, 1), (1, "c2", 0.8, 2), (2, "c3", 0.9, 1), (2, "c2", 0.8, 2), (2, "c1", 0.7, 3)]), hit([(2, "c1", 0.5, 1)])
    qs = spark.createDataFrame([(1, "exact phrase", None), (2, "zzz", ["national"])], "query_id int, query string, active_scope array<string>")
    got, stats = R.retrieve(qs, chunks, vec, fts)
    rows = [(r.query_id, r.chunk_id, r.short_circuit, round(r.score, 6)) for r in got.orderBy("query_id", "final_rank").collect()]
    assert rows[0] == (1, "c2", True, 1.0) and len([r for r in rows if r[0] == 1]) == 1
    assert [r[1] for r in rows if r[0] == 2] == ["c1"]
    s = {r.query_id: (r.vector_hits, r.fts_hits, r.both_hits) for r in stats.collect()}
    assert s == {1: (1, 0, 0), 2: (2, 0, 1)}
    plain, none = R.retrieve(qs.where("query_id = 1"), chunks, hit([(1, "c2", 1.0, 1), (1, "c1", 0.8, 2)]), None)
    assert none is None
    assert [(r.chunk_id, round(r.final_score, 6)) for r in plain.orderBy("final_rank").collect()] == [("c1", 1.6), ("c2", 1.4)]


def test_chunks_are_neither_sent_nor_read_again(spark):
    """Queries and names of hits go to the chunks; hits then come with the chunks that were hit alone."""
    place = fresh_path(spark, "chunks")
    chunks = spark.range(50).select(
        F.col("id").alias("chunk_id"), F.concat(F.lit("red w"), "id").alias("text"), F.array(F.lit("national")).alias("scope_path"), F.lit(None).cast("string").alias("doc_type"),
        F.lit("d").alias("doc_hash"), F.array().cast("array<map<string,string>>").alias("form_fields"), F.array().cast("array<struct<index:int,header:string>>").alias("column_headers"),
    )
    chunks.write.parquet(place)
    chunks = spark.read.parquet(place)
    queries = spark.createDataFrame([(1, "red", None), (2, "w7", None)], "query_id long, query string, active_scope array<string>")
    found = R.bm25_topk(queries.select("query_id", "query"), chunks.select("chunk_id", "text"))
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    hits, _ = R.retrieve(queries, chunks, found, found)
    assert {(r.query_id, r.chunk_id) for r in hits.where("query_id = 2").collect()} == {(2, 7)} and hits.where("query_id = 1").count() == 40
    assert "parquet" not in hits._jdf.queryExecution().optimizedPlan().toString()
