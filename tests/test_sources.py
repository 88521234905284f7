import gzip
import hashlib
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from clausemesh.functions import register
from clausemesh.operators import store as ST
from clausemesh.plans import ingest as IN
from clausemesh.session import shared_dir
from clausemesh.sources import blocks as B
from clausemesh.sources import files as FS


def line(doc, i, **more):
    return json.dumps({"doc_id": doc, "block_id": f"b{i}", "type": "text", "content": {"raw": f"text {i}."}} | more, ensure_ascii=False)


@pytest.fixture
def corpus(tmp_path):
    files = {
        "good": [line("good", 0), "", line("good", 1, metadata={"heading_path": ["h"], "page_number": 2})],
        "torn": [line("torn", 0), '{"doc_id": "torn"'],
        "missing": [json.dumps({"doc_id": "missing", "type": "text"})],
        "listraw": [line("listraw", 0, content={"raw": ["a", "b"]})],
        "blank": [""],
        "empty": [line("empty", 0, content={})],
    }
    for name, lines in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "data.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "good" / "index.json").write_text(json.dumps({"file_name": "GB150-2011.pdf"}))
    (tmp_path / "torn" / "index.json").write_text("{nope")
    return tmp_path


def test_ingest_of_files(spark, corpus):
    lines = B.number_lines(B.read_lines(spark, f"{corpus}/*/data.jsonl")).withColumn("bundle_id", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    lines = lines.select("bundle_id", "line_no", "value")
    names = B.read_index_names(spark, f"{corpus}/*/index.json")
    notices = spark.createDataFrame([(n, 1, n) for n in ("good", "torn", "missing", "listraw", "blank", "empty", "absent", "old")], "doc_hash string, version int, bundle_id string")
    done = spark.createDataFrame([("old", 1, 7)], "doc_hash string, version int, chunks_indexed long")
    chunks, outcomes = IN.ingest(notices, lines, names, done)
    got = {r.doc_hash: (r.rag_status, r.error_code, r.chunks_indexed) for r in outcomes.collect()}
    assert got == {
        "good": ("success", None, 2), "torn": ("failed", "ir_parse_error", 0), "missing": ("failed", "ir_parse_error", 0),
        "listraw": ("failed", "ir_parse_error", 0), "blank": ("failed", "jsonl_empty", 0), "empty": ("failed", "no_chunks", 0),
        "absent": ("failed", "jsonl_missing", 0), "old": ("success", None, 7),
    }
    rows = chunks.orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["text 0.", "text 1."] and rows[0].doc_type == "national_standard" and rows[1].scope_path == ["h"]
    stored = ST.with_keys(chunks)
    assert IN.merge_store(stored, chunks).count() == 2
    _, again = IN.reparse(notices.where("doc_hash in ('old', 'torn')"), lines, done)
    assert {r.doc_hash: r.rag_status for r in again.collect()} == {"old": "duplicate", "torn": "business_failure"}


def test_rules_fail_early(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [{"pattern": "^A", "doc_type": "t", "priority": 500}], "default": {"doc_type": "u", "priority": 1}}))
    with pytest.raises(ValueError):
        B.load_rules(spark, str(path))
    path.write_text(json.dumps({"rules": [{"pattern": "^A", "doc_type": "t", "priority": 5}], "default": {"doc_type": "u", "priority": 1}}))
    rules, default = B.load_rules(spark, str(path))
    got = spark.createDataFrame([("abc",), ("x",), ("",)], "n string").select(B.classify(F.col("n"), rules, default).getField("doc_type")).collect()
    assert [r[0] for r in got] == ["t", "u", "u"]


def test_side_files(spark, tmp_path):
    plain = [json.dumps({"event": "constraint_solved", "trace_id": "t", "branches_count": 2, "scope_path": ["a"]}), '{"event": "to']
    (tmp_path / "audit.log").write_text("\n".join(plain))
    with gzip.open(tmp_path / "audit.log.1.gz", "wt") as f:
        f.write(json.dumps({"event": "ingestion_completed", "doc_id": "d"}) + "\n")
    events = FS.read_audit(spark, f"{tmp_path}/audit.log*")
    assert sorted(r.event for r in events.collect()) == ["constraint_solved", "ingestion_completed"]
    FS.write_audit(events.select("event", "trace_id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("timestamp is not null").count() == 2
    (tmp_path / "manifest.json").write_text(json.dumps({"recommended_first": [], "full_list": [{"bundle_id": f"b{i}", "filename": "f"} for i in range(20)]}))
    got = FS.read_manifest(spark, str(tmp_path / "manifest.json")).collect()
    assert len(got) == 15 and got[0].doc_type == "unknown"
    (tmp_path / "ck.json").write_text(json.dumps({"version": 1, "failed": [{"name": "a", "status": "failed"}, "b"]}))
    assert [tuple(r) for r in FS.read_checkpoint(spark, str(tmp_path / "ck.json")).collect()] == [("a", "failed"), ("b", None)]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert FS.file_digests(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    FS.write_name_list(spark.createDataFrame([("b",), ("a",), ("b",)], "doc_hash string"), str(tmp_path / "names"))
    assert sorted(r.doc_hash for r in FS.read_name_list(spark, str(tmp_path / "names")).collect()) == ["a", "b"]


def test_sql_functions(spark):
    import uuid

    register.register(spark)
    row = spark.sql("SELECT estimate_tokens('abcdefgh') AS t, to_celsius(212, '°F') AS c, request_id('t', 'd', 1) AS r, lot_label('7-Lot007 x') AS l, sha1_uuid('d:1:c') AS u").first()
    assert (row.t, row.c, row.l) == (2, 100.0, "Lot 7") and row.r == hashlib.md5(b"t|d|1").hexdigest()
    assert row.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "d:1:c"))


def test_index_files_are_dealt_over_tasks_and_listed_in_few(spark, tmp_path):
    rows = spark.range(200).coalesce(1).select(F.col("id").cast("string").alias("bundle"), F.format_string('{"file_name": "f%d"}', "id").alias("value"))
    path = str(tmp_path / "indices")
    B.write_index_files(rows, path, "bundle")
    files = list((tmp_path / "indices").glob("*/*.txt"))
    assert len(files) == 200 and len({f.name.split("-")[1] for f in files}) > 1  # before, one task wrote them all
    before, tracker = spark.conf.get(B.LISTING), spark.sparkContext.statusTracker()
    jobs = set(tracker.getJobIdsForGroup(None))
    names = B.read_index_names(spark, path, "*.txt")
    stages = [tracker.getStageInfo(s) for j in set(tracker.getJobIdsForGroup(None)) - jobs for s in tracker.getJobInfo(j).stageIds]
    assert all(s.numTasks < 200 for s in stages if s) and spark.conf.get(B.LISTING) == before
    assert {(r.bundle_id, r.file_name) for r in names.collect()} == {(f"bundle={i}", f"f{i}") for i in range(200)}


def test_ingest_stores_texts_once(spark, tmp_path):
    """What an ingest leaves in the shared folder is about the chunks' texts, for short documents, and documents of many lines
    or of several bundles are as those of few."""
    def grown(fn):
        size = lambda: sum(f.stat().st_size for f in pathlib.Path(shared_dir(spark)).rglob("*") if f.is_file())
        before = size()
        return fn(), size() - before

    rng = random.Random(1)
    line = lambda doc, n, text: (doc, n, json.dumps({"doc_id": doc, "block_id": f"b{n}", "type": "text", "content": {"raw": text}}))
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500)) for _ in range(200)]
    lines = spark.createDataFrame([line(f"d{i % 20}", i // 20, t) for i, t in enumerate(texts)], "bundle_id string, line_no long, value string")
    notices = lines.selectExpr("bundle_id doc_hash", "1 version", "bundle_id").distinct()
    names = spark.createDataFrame([], "bundle_id string, file_name string")
    done = spark.createDataFrame([], "doc_hash string, version int, chunks_indexed long")
    (chunks, _), left = grown(lambda: IN.ingest(notices, lines, names, done))
    assert chunks.agg(F.sum(F.length(F.regexp_replace("text", "\n", "")))).first()[0] == 100_000
    assert left < 1.5 * 3 * 100_000  # three bytes a character

    many = [("long", n, n, f"line {n}") for n in range(2500)] + [("one", n, n, f"first {n}") for n in range(3)] + [("two", n, n + 3, f"next {n}") for n in range(3)] + [("torn", n, n, f"x {n}") for n in range(1100)]
    lines = spark.createDataFrame([line(b, k, t) for b, n, k, t in many] + [("torn", 2000, "{")], lines.schema)
    notices = spark.createDataFrame([("long", 1, "long"), ("both", 1, "one"), ("both", 1, "two"), ("torn", 1, "torn")], "doc_hash string, version int, bundle_id string")
    chunks, outcomes = IN.ingest(notices, lines, names, done, max_tokens=50)
    got = {}
    for r in chunks.orderBy("doc_hash", "chunk_index").collect():
        got.setdefault(r.doc_hash, []).append(r)
    assert {d: [r.chunk_index for r in rows] for d, rows in got.items()} == {d: list(range(len(rows))) for d, rows in got.items()}
    assert {d: "\n".join(r.text for r in rows).split("\n") for d, rows in got.items()} == {
        "long": [f"line {n}" for n in range(2500)], "both": [*(f"first {n}" for n in range(3)), *(f"next {n}" for n in range(3))],
    }
    assert sorted((r.doc_hash, r.rag_status, r.error_code) for r in outcomes.collect()) == [
        ("both", "success", None), ("both", "success", None), ("long", "success", None), ("torn", "failed", "ir_parse_error"),
    ]
