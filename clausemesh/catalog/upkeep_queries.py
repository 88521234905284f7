"""Queries on stores and streams that are kept up (what is left in them after several changes), SQL functions, encodings and
replays, against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import register as RG
from ..functions import sparse as SV
from ..operators import encoding as EN
from ..operators import hints as H
from ..operators import replay as RP
from ..operators.inverted import InvertedIndex
from ..plans import ingest as IN
from ..session import cut_lineage, fresh_path
from ..streaming import jobs as J
from ..streaming import stateful as SF
from ..streaming.committed import CommittedTable
from .base import ORACLES, QUERIES, block_lines, doc_corpus, event_seconds, part_chunks, query, rounded, spread, table
from .ops_queries import QUOTA_SQL
from .search_queries import FTS, SPARSE, _sparse_hits, _words, doc_chunks_sql


def _kept_index(spark, d, name: str) -> InvertedIndex:
    """All documents in four changes: old texts of most, texts to be deleted, the deletion, and the present texts."""
    docs = doc_corpus(spark, d).select("chunk_id", F.col("chunk_id").cast("string").alias("doc_hash"), "text", "lang")
    index = InvertedIndex(spark, fresh_path(spark, name))
    english = F.col("lang") == "en"
    index.update(docs.where(english).withColumn("text", F.concat(F.lit("stale "), F.reverse("text"))).drop("lang"))
    other = docs.where(~F.coalesce(english, F.lit(False))).drop("lang")
    index.update(other.withColumns({"doc_hash": F.concat(F.lit("x"), "doc_hash"), "chunk_id": -1 - F.col("chunk_id")}))
    index.update(other)
    index.delete(other.select(F.concat(F.lit("x"), "doc_hash").alias("doc_hash")))
    index.update(docs.where(english).drop("lang"))
    return index


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("index_bm25", f"WITH {FTS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ft WHERE rank <= 40")
def index_bm25(spark, d):
    """Ranks from an index whose documents were replaced and deleted are those of the present documents."""
    hits = _kept_index(spark, d, "index").bm25(_benchmark(spark, d))
    return hits.select("query_id", "chunk_id", rounded("score"), F.col("rank").cast("long").alias("rank"))


@query("index_bm25_merged", f"WITH {FTS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ft WHERE rank <= 40")
def index_bm25_merged(spark, d):
    """The same after its segments were merged into two."""
    index = _kept_index(spark, d, "index")
    index.merge(max_segments=2)
    return index.bm25(_benchmark(spark, d)).select("query_id", "chunk_id", rounded("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "index_phrases",
    """WITH h AS (SELECT p_partkey AS chunk_id, len(string_split(p_name, ' ')) + 0.0::DOUBLE AS dl, starts_with(p_name, 'small ri') AS hit FROM part),
s AS (SELECT count(*) AS n, avg(dl) AS avg_len, count(*) FILTER (hit) AS df FROM h)
SELECT chunk_id, round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)), 6) AS bm25
FROM h, s WHERE hit""",
)
def index_phrases(spark, d):
    """A phrase from the positions of an index that holds every part twice, the second time in place of the first."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("doc_hash"), F.col("p_name").alias("text"))
    index = InvertedIndex(spark, fresh_path(spark, "index"))
    index.update(p.withColumn("text", F.lit("small ring")))
    index.update(p)
    q = p.agg(F.min(F.lit(1)).alias("query_id")).withColumn("query", F.lit("small-ri"))
    return index.bm25(q, k=None).select("chunk_id", rounded("bm25"))


# --- streams -----------------------------------------------------------------------------------------------------


def _files(df, name: str) -> str:
    """The rows as a folder of files, as they would arrive."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _retry_tasks(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    return o.select(
        F.concat(n.cast("string"), F.lit("/"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("request_id"),
        F.when(n % 11 == 0, "COMPLETED").when(n % 2 == 0, "PENDING").otherwise("FAILED").alias("status"),
        (n % 4).cast("int").alias("attempts"), F.when(n % 3 == 0, "old").alias("last_error"), F.lit(0.0).alias("updated_at"), (n % 13 == 0).cast("int").alias("unwired_skipped"),
    )


def third_time_lucky(request_id: str, attempt: int) -> tuple[bool, str | None]:
    """A handler that works from the attempt on that the task's name ends in."""
    need = int(request_id.rsplit("/", 1)[1])
    return attempt >= need, f"no {attempt}" if attempt < need and attempt % 2 else None


@query(
    "stream_retry_timers",
    f"""WITH t AS (SELECT o_orderkey::VARCHAR || '/' || (o_custkey % 5 + 1) AS request_id, o_custkey % 5 + 1 AS need, (o_orderkey % 4)::INTEGER AS had, CASE WHEN o_orderkey % 3 = 0 THEN 'old' END AS err
  FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 4 < {K.MAX_ATTEMPTS}),
a AS (SELECT *, greatest(had + 1, least(need, {K.MAX_ATTEMPTS}))::INTEGER AS attempts FROM t)
SELECT request_id, CASE WHEN attempts >= need THEN 'COMPLETED' ELSE 'FAILED' END AS status, attempts,
  CASE WHEN attempts < need THEN array_to_string(list_filter(list_concat([err],
    list_transform(generate_series(had + 1, attempts), lambda i: CASE WHEN i % 2 = 1 THEN 'no ' || i ELSE '{K.RETRY_FALSE_ERROR}' END)), lambda x: x IS NOT NULL), ' | ') END AS last_error
FROM a""",
)
def stream_retry_timers(spark, d):
    """Where every task ends that waits on a timer of its own for each attempt."""
    tasks = _retry_tasks(spark, d)
    stream = spark.readStream.schema(tasks.schema).parquet(_files(tasks, "tasks"))
    path = fresh_path(spark, "attempts")
    rows = SF.timed_retries(stream, third_time_lucky, age=0.001)
    n = tasks.where(F.col("status").isin(*K.RETRY_STATUSES) & (F.col("unwired_skipped") == 0) & (F.col("attempts") < K.MAX_ATTEMPTS)).count()
    spark.createDataFrame([], SF.RETRY_SCHEMA).write.parquet(f"{path}/epoch=-1")
    done = lambda: spark.read.schema(SF.RETRY_SCHEMA).parquet(path).where((F.col("status") == "COMPLETED") | (F.col("attempts") >= K.MAX_ATTEMPTS)).count() >= n
    keep = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # noqa: E731  a batch that runs again writes it over
    SF.run_until(rows.writeStream.foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "retry-progress")).start(), done)
    every = spark.read.schema(SF.RETRY_SCHEMA).parquet(path)
    last = every.groupBy("request_id").agg(F.max_by(F.struct("status", "attempts", "last_error"), "attempts").alias("s"))
    return last.select("request_id", "s.*")


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """An encoder: length and number of vowels."""
    return [[float(len(t)), float(sum(c in "aeiou" for c in t))] for t in texts]


def _drained(spark, stream, name: str, progress: str | None = None):
    path = fresh_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress or fresh_path(spark, f"{name}-progress"))
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return q, path


@query("stream_encodings_ttl", QUOTA_SQL.format(us=36_000_000_000) + " SELECT event_id AS id, pos > 1 AS reused, true AS right_vector FROM w")
def stream_encodings_ttl(spark, d):
    """An encoding of each user's text is kept for ten hours; a stale one is made again."""
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("id"), F.concat(F.lit("text of "), F.col("user_id").cast("string")).alias("text"), event_seconds().alias("at")
    )
    stream = spark.readStream.schema(e.schema).parquet(_files(e, "texts"))
    # a window of the quota ends at ten hours, when a kept encoding would still be good
    rows = SF.encodings_with_ttl(stream, letter_vectors, 36_000 - 1e-6)
    path, n = fresh_path(spark, "encodings"), e.count()
    spark.createDataFrame([], SF.ENCODING_SCHEMA).write.parquet(f"{path}/epoch=-1")
    kept = lambda: spark.read.schema(SF.ENCODING_SCHEMA).parquet(path)
    keep = lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    SF.run_until(rows.writeStream.foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "encodings-progress")).start(), lambda: kept().count() >= n)
    right = F.col("vector")[0] == F.length(F.concat(F.lit("text of "), F.col("cache_key")))
    return kept().select("id", "reused", (right & (F.col("encoded_at") <= F.col("at"))).alias("right_vector"))


LATE_SQL = """
s AS (SELECT *, epoch_us(ts) AS us, event_id % 40 = 0 AS held FROM events),
cut AS (SELECT quantile_disc(us, 0.7) AS us FROM s),
a AS (SELECT s.* FROM s, cut WHERE s.us <= cut.us AND NOT held),
b AS (SELECT s.* FROM s, cut WHERE NOT (s.us <= cut.us AND NOT held)),
wa AS (SELECT max(us) // 1000 - 3600000 AS ms FROM a),
wb AS (SELECT greatest((SELECT ms FROM wa), max(us) // 1000 - 3600000) AS ms FROM b),
good AS (SELECT * FROM a UNION ALL SELECT b.* FROM b, wa WHERE us > ms * 1000),
late AS (SELECT count(*) AS n FROM b, wa WHERE us <= ms * 1000)"""


@query(
    "stream_windows_late",
    f"""WITH {LATE_SQL},
w AS (SELECT event_type AS label, us // 7200000000 * 7200000 AS start_ms, count(*) AS total, count(*) FILTER (value <= 10) AS le_0, count(*) FILTER (value <= 100) AS le_1 FROM good GROUP BY 1, 2)
SELECT label, start_ms, total, le_0, le_1, late.n AS late_rows FROM w, wb, late WHERE start_ms + 7200000 <= wb.ms""",
)
def stream_windows_late(spark, d):
    """Windows of two hours as the watermark closes them, in a stream that stops and goes on; one event in forty comes
    with the second part, and those of them that are too late are counted and left out."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    cut = e.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY unix_micros(ts))").alias("us")).first()["us"]
    first = (us <= cut) & (F.col("event_id") % 40 != 0)
    path, progress = fresh_path(spark, "events"), fresh_path(spark, "windows-progress")
    out, late = [], 0
    for part in (e.where(first), e.where(~first)):
        part.write.mode("append").parquet(path)
        stream = SF.closed_windows(spark.readStream.schema(e.schema).parquet(path), "ts", "event_type", "value", [10.0, 100.0], 7200, "1 hour")
        q, where = _drained(spark, stream, "windows", progress)
        out.append(where)
        late += SF.late_rows(q)
    rows = spark.read.schema("label string, start_ms long, total long, value_sum double, below array<long>").parquet(*out)
    return rows.select("label", "start_ms", "total", F.col("below")[0].alias("le_0"), F.col("below")[1].alias("le_1"), F.lit(late).cast("long").alias("late_rows"))


class Crash(RuntimeError):
    """A planned failure between the rows of a batch and its commit."""


@query(
    "stream_ingest",
    f"""WITH RECURSIVE {doc_chunks_sql()}
SELECT doc_id::VARCHAR AS doc_hash, 2 AS version, chunk_index, md5(text) AS text_md5, token_count FROM dc WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'es')""",
)
def stream_ingest(spark, d):
    """Bundles arrive in two versions, the newer one first; the stream fails between the rows and the commit of its second
    batch, and is started again. Every chunk of the newer version is there once."""
    lines = block_lines(spark, d).where("lang <> 'es'")
    path, progress = fresh_path(spark, "bundles"), fresh_path(spark, "ingest-progress")
    wide = lines.withColumn("folder", F.concat(F.lit("part"), F.pmod(F.xxhash64("bundle_id"), F.lit(3)).cast("string")))
    present = wide.select("folder", F.to_json(F.struct("bundle_id", F.lit(2).alias("version"), "line_no", F.col("value").alias("line"))).alias("value"))
    older = wide.where("line_no = 0").select(F.lit("zold").alias("folder"), F.to_json(F.struct("bundle_id", F.lit(1).alias("version"), "line_no", F.col("value").alias("line"))).alias("value"))
    # a task writes its own bundles, each whole in one file; compressed files cannot be cut, so there are many
    present.write.partitionBy("folder").text(path, compression="gzip")
    older.write.mode("append").partitionBy("folder").text(path, compression="gzip")
    n_files = len(spark.read.text(path).inputFiles())
    target = CommittedTable(spark, fresh_path(spark, "chunks"))

    def chunks_of(arrived):
        row = F.from_json("value", "bundle_id string, version int, line_no long, line string")
        block = arrived.select(row.alias("r")).select(F.concat_ws("@", "r.bundle_id", "r.version").alias("bundle_id"), "r.line_no", F.col("r.line").alias("value"))
        names = cut_lineage(block.select("bundle_id").distinct())
        notices = names.select("bundle_id", F.split("bundle_id", "@")[0].alias("doc_hash"), F.split("bundle_id", "@")[1].cast("int").alias("version"))
        chunks, _ = IN.ingest(notices, block, names.withColumn("file_name", F.lit(None).cast("string")), spark.createDataFrame([], "doc_hash string, version int, chunks_indexed bigint"))
        return chunks

    def fail(epoch: int) -> None:
        if epoch == 1 and not crashed:
            crashed.append(epoch)
            raise Crash("between rows and commit")

    crashed: list[int] = []
    start = lambda: J.ingest_once(spark, f"{path}/*/*.txt.gz", progress, target, chunks_of, max_files=-(-n_files // 4), before_commit=fail)
    try:
        start().awaitTermination()
    except Exception as error:  # the stream reports the failure of its batch in an error of its own
        if not crashed or "between rows and commit" not in str(error):
            raise
        start().awaitTermination()
    target.compact(J.newest_versions)
    return J.newest_versions(target.read()).select("doc_hash", "version", "chunk_index", F.md5("text").alias("text_md5"), "token_count")


# --- SQL functions -----------------------------------------------------------------------------------------------


@query("sql_hints", ORACLES["spec_hints"])
def sql_hints(spark, d):
    """Numbers with units by a lateral join with a table function."""
    RG.register(spark)
    part_chunks(spark, d).createOrReplaceTempView("sql_hints_parts")
    return spark.sql("SELECT p.chunk_id, h.hint_ord, h.parameter_hint, h.value, h.unit FROM sql_hints_parts p, LATERAL hints(p.text) h")


@query("sql_units", ORACLES["unit_normalize"])
def sql_units(spark, d):
    """Units by an SQL function."""
    RG.register(spark)
    table(spark, d, "events").createOrReplaceTempView("sql_units_events")
    unit = "element_at(array('mm', '°F', 'K', 'MPa', 'acre', '小时', '%', 'widget'), int(user_id % 8) + 1)"
    return spark.sql(f"SELECT event_id, round(r.value, 9) + 0D AS value, r.unit, r.category FROM (SELECT event_id, normalize_unit(value, {unit}) AS r FROM sql_units_events)")


@query("sql_deadlines", ORACLES["deadlines"])
def sql_deadlines(spark, d):
    """Deadlines by an SQL function."""
    RG.register(spark)
    table(spark, d, "part").createOrReplaceTempView("sql_deadlines_part")
    text = "p_name || if(p_partkey % 4 < 2, '后 ', '起') || p_size || element_at(array('天', '周', '个月', '工作日'), int(p_partkey % 4) + 1) || '内'"
    return spark.sql(f"SELECT p_partkey AS part_id, r.* FROM (SELECT p_partkey, parse_deadline({text}) AS r FROM sql_deadlines_part)")


@query(
    "sql_provisions",
    "SELECT p_partkey AS part_id, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS provision_id, CASE WHEN p_partkey % 3 = 0 THEN 'Lot ' || p_size::VARCHAR END AS lot FROM part",
)
def sql_provisions(spark, d):
    """Provision numbers and lots by SQL functions."""
    RG.register(spark)
    table(spark, d, "part").createOrReplaceTempView("sql_provisions_part")
    return spark.sql(
        "SELECT p_partkey AS part_id, provision_id(array('x', 'clause ' || (p_size DIV 10) || '.' || (p_size % 10))) AS provision_id,"
        " lot_label(if(p_partkey % 3 = 0, '7-LOT 00' || p_size || ' NCR.doc', p_name)) AS lot FROM sql_provisions_part"
    )


# --- operators by distance ---------------------------------------------------------------------------------------


@query(
    "nearest_operators",
    """SELECT p_partkey AS chunk_id, u.unit, u.near AS nearest_operator, u.near_lower, u.near_upper, '<=' AS first_operator FROM part,
  (VALUES ('mm', '<=', false, true), ('MPa', '>=', true, false)) u(unit, near, near_lower, near_upper)""",
)
def nearest_operators(spark, d):
    """'at most 5 mm, at least 6 MPa' in two scripts: each number has its own operator by distance, and both have the first
    one by list order."""
    size = F.col("p_size").cast("string")
    low, high = F.when(F.col("p_partkey") % 2 == 0, "不超过").otherwise("at most "), F.when(F.col("p_partkey") % 3 == 0, "不低于").otherwise("at least ")
    text = F.concat(low, size, F.lit(" mm, "), high, size, F.lit("8 MPa"))
    hints = H.extract_hints(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("chunk_id"), text.alias("text")))
    near = H.parse_operators(hints, nearest=True).withColumnRenamed("operator", "nearest_operator").withColumns(
        {"near_lower": F.col("interval.lower").isNotNull(), "near_upper": F.col("interval.upper").isNotNull()}
    ).select(*hints.columns, "nearest_operator", "near_lower", "near_upper")
    # both readings of a hint on its own row: texts are searched once, and nothing is joined
    return H.parse_operators(near).select("chunk_id", "unit", "nearest_operator", "near_lower", "near_upper", F.col("operator").alias("first_operator"))


# --- sparse vectors ----------------------------------------------------------------------------------------------


def _sorted_vectors(words, key):
    counts = words.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    entries = F.collect_list(F.struct(SV.term_index(F.col("term")).alias("index"), F.col("n").cast("double").alias("value")))
    return counts.groupBy(key).agg(entries.alias("entries")).select(key, SV.sorted_vector(F.col("entries")).alias("vector"))


@query("sparse_merge_dot", f"WITH {SPARSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM st WHERE rank <= 40")
def sparse_merge_dot(spark, d):
    """The scores of the sparse hits, once more by merging sorted vectors of query and document."""
    hits = _sparse_hits(spark, d).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
    docs = table(spark, d, "documents").join(hits.select(F.col("chunk_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    left = _sorted_vectors(_words(table(spark, d, "benchmark"), "item_id", "query_id"), "query_id").withColumnRenamed("vector", "a")
    right = _sorted_vectors(_words(docs, "doc_id", "chunk_id"), "chunk_id").withColumnRenamed("vector", "b")
    rows = hits.join(left, "query_id").join(right, "chunk_id").withColumn("score", SV.merge_dot(F.col("a"), F.col("b")))
    return rows.select("query_id", "chunk_id", rounded("score"), "rank")


# --- encodings ---------------------------------------------------------------------------------------------------


def _known(spark, d):
    """Stored vectors: those of the texts that only German documents have."""
    docs = doc_corpus(spark, d).withColumn("cache_key", EN.cache_key(F.col("text"), F.lit("m1")))
    return docs.groupBy("cache_key").agg(F.min(F.coalesce("lang", F.lit(""))).alias("low"), F.max(F.coalesce("lang", F.lit(""))).alias("high")).where("low = 'de' AND high = 'de'").select(
        "cache_key", F.array(F.lit(-1.0)).alias("vector")
    )


@query(
    "encode_fan_out",
    """WITH k AS (SELECT text, min(coalesce(lang, '')) = 'de' AND max(coalesce(lang, '')) = 'de' AS known FROM documents GROUP BY text)
SELECT doc_id, CASE WHEN k.known THEN -1 ELSE length(d.text) END::DOUBLE AS first FROM documents d JOIN k ON k.text = d.text""",
)
def encode_fan_out(spark, d):
    """Each different text goes through the encoder once, its vector to all rows of the text."""
    docs, stored = doc_corpus(spark, d), _known(spark, d)
    new = EN.encode_missing(docs, stored, letter_vectors, F.lit("m1"))
    return EN.encode_rows(docs, stored, new, F.lit("m1")).select(F.col("chunk_id").alias("doc_id"), F.col("vector")[0].alias("first"))


@query(
    "encode_calls",
    """WITH k AS (SELECT text FROM documents GROUP BY text HAVING NOT (min(coalesce(lang, '')) = 'de' AND max(coalesce(lang, '')) = 'de'))
SELECT count(*) AS texts, true AS in_batches, true AS refused FROM k""",
)
def encode_calls(spark, d):
    """Texts that reached the encoder; no call had more than a batch; a dummy encoder's vectors were not stored."""
    new = EN.encode_missing(doc_corpus(spark, d), _known(spark, d), letter_vectors, F.lit("m1"), batch=16)
    refused, path = False, fresh_path(spark, "encodings")
    try:
        EN.store_encodings(new, path, dummy=True)
    except EN.DummyWrite:
        refused = True
    calls = new.groupBy("call").agg(F.count(F.lit(1)).alias("n"))
    return calls.agg(F.sum("n").alias("texts"), (F.max("n") <= 16).alias("in_batches")).withColumn("refused", F.lit(refused))


# --- replay ------------------------------------------------------------------------------------------------------


@query(
    "replay_runs_again",
    f"""SELECT (SELECT count(*) FROM ({ORACLES["question_constraints"]}))::BIGINT AS n_rows, 'full_match' AS same, 'input_changed' AS other_input, 'version_changed' AS other_version, 'mismatch' AS other_result""",
)
def replay_runs_again(spark, d):
    """Questions are solved again from the same inputs and compared with the record of the first run; a changed input, a
    changed plan and a changed result are told apart."""
    names = ("documents", "benchmark")
    inputs = lambda: {n: table(spark, d, n) for n in names}
    run = lambda: QUERIES["question_constraints"](spark, d)
    first = RP.record(run, inputs(), "1")
    again = RP.replay(first, run, {n: df.repartition(3) for n, df in inputs().items()}, "1")
    changed = inputs() | {"benchmark": table(spark, d, "benchmark").withColumn("text", F.reverse("text"))}
    different = lambda: inputs()["benchmark"]
    other = [RP.replay(first, run, changed, "1"), RP.replay(first, run, inputs(), "2"), RP.replay(first, different, inputs(), "1")]
    columns = [F.lit(x).alias(c) for x, c in zip(other, ("other_input", "other_version", "other_result"))]
    return spark.range(1).select(F.lit(int(first["n_rows"])).cast("long").alias("n_rows"), F.lit(again).alias("same"), *columns)
