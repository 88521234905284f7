"""Queries that go through side files and back, and queries on cases, verdicts and life cycle of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scope as S
from ..operators import hints as H
from ..operators import labels as L
from ..operators import store as ST
from ..session import fresh_path
from ..sources import blocks as B
from ..sources import files as FS
from .base import CENTROIDS, ORACLES, part_chunks, query, rounded, table
from .ops_queries import _recall_parts, recall_eval

# --- side files ------------------------------------------------------------------------------------------------------


@query("audit_appended", "SELECT event_type AS event, count(*) AS n, count(DISTINCT user_id::VARCHAR) AS traces, true AS timed FROM events GROUP BY 1")
def audit_appended(spark, d):
    """Events appended to the audit log in two writes, without and with a time of their own, and read back."""
    e = table(spark, d, "events").select(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("trace_id"), (F.col("event_id") % 2 == 0).alias("even"))
    path = fresh_path(spark, "audit")
    FS.write_audit(e.where("even").drop("even"), path)
    FS.write_audit(e.where("not even").drop("even").withColumn("timestamp", F.lit("2024-01-01T00:00:00")), path)
    back = FS.read_audit(spark, path)
    return back.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"), (F.count("timestamp") == F.count(F.lit(1))).alias("timed"))


@query(
    "manifest_bundles",
    """SELECT bundle_id, doc_type, n_blocks FROM (SELECT n_name AS bundle_id, CASE WHEN n_regionkey = 0 THEN 'unknown' ELSE 'type ' || n_regionkey END AS doc_type, n_nationkey::INTEGER AS n_blocks
  FROM nation ORDER BY n_name LIMIT 15)""",
)
def manifest_bundles(spark, d):
    """The first bundles of a manifest file."""
    entry = F.struct(F.col("n_name").alias("bundle_id"), F.lit("f").alias("filename"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("type "), F.col("n_regionkey").cast("string"))).alias("doc_type"), F.col("n_nationkey").cast("int").alias("n_blocks"))
    whole = table(spark, d, "nation").agg(F.sort_array(F.collect_list(entry)).alias("full_list"), F.array().cast("array<string>").alias("recommended_first"))
    path = fresh_path(spark, "manifest")
    whole.write.json(path)
    return FS.read_manifest(spark, path).select("bundle_id", "doc_type", "n_blocks")


@query("index_file_names", "SELECT p_partkey::VARCHAR AS bundle_id, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_name END AS file_name FROM part WHERE p_partkey % 20 = 1")
def index_file_names(spark, d):
    """File names from one index file in each bundle's folder, some empty and some torn."""
    k = F.col("p_partkey") % 3
    p = table(spark, d, "part").where("p_partkey % 20 = 1").select(
        F.col("p_partkey").cast("string").alias("bundle"), F.when(k == 2, '{"file_name": "to').otherwise(F.to_json(F.struct(F.when(k == 0, "").otherwise(F.col("p_name")).alias("file_name")))).alias("value")
    )
    path = fresh_path(spark, "indices")
    B.write_index_files(p, path, "bundle")
    return B.read_index_names(spark, path, "*.txt").select(F.regexp_replace("bundle_id", "^bundle=", "").alias("bundle_id"), "file_name")


@query("source_digests", "SELECT n_nationkey::VARCHAR AS source, sha256(n_name || chr(10)) AS sha256 FROM nation")
def source_digests(spark, d):
    """Digests of source files, one for each nation."""
    path = fresh_path(spark, "sources")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("value")).write.partitionBy("source").text(path)
    return FS.file_digests(spark, f"{path}/*/*.txt").select(F.regexp_extract("source_path", "source=([^/]+)/", 1).alias("source"), "sha256")


@query(
    "rule_file_types",
    """SELECT p_partkey AS part_id, CASE WHEN p_name LIKE 'blue%' THEN 'sea' WHEN contains(lower(p_name), 'bolt') THEN 'fastener' ELSE 'rest' END AS doc_type,
  CASE WHEN p_name LIKE 'blue%' THEN 90 WHEN contains(lower(p_name), 'bolt') THEN 10 ELSE 0 END::INTEGER AS priority FROM part""",
)
def rule_file_types(spark, d):
    """Document types by the rules of a file."""
    path = fresh_path(spark, "rules")
    rule = lambda p, t, n: F.struct(F.lit(p).alias("pattern"), F.lit(t).alias("doc_type"), F.lit(n).alias("priority"))
    rules = F.array(rule("^blue", "sea", 90), rule("BOLT", "fastener", 10)).alias("rules")
    spark.range(1).select(rules, F.struct(F.lit("rest").alias("doc_type"), F.lit(0).alias("priority")).alias("default")).write.json(path)
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.inline(F.array(B.classify(F.col("p_name"), *B.load_rules(spark, path)))))


# --- text to verdict -------------------------------------------------------------------------------------------------


@query(
    "context_hints",
    """SELECT p_partkey AS chunk_id, CASE p_partkey % 7 WHEN 0 THEN 'temperature' WHEN 1 THEN 'pressure' WHEN 2 THEN 'diameter' WHEN 3 THEN 'length' WHEN 4 THEN 'strength' WHEN 5 THEN 'percentage' ELSE 'length' END AS parameter_hint,
  p_size::DOUBLE AS value, 'mm' AS unit FROM part""",
)
def context_hints(spark, d):
    """Numbers whose parameter comes from a word and a digit before them, not from their unit."""
    words = F.array(*[F.lit(w) for w in ("油温 2 级", "水压:3 级", "公称直径 4 号", "厚度 5 号", "抗拉强度 6 级", "含水率 7 级", "油温")])
    text = F.concat(F.get(words, (F.col("p_partkey") % 7).cast("int")), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mm"))
    # the last has no digit between the word and the number: the unit's category stays
    text = F.when(F.col("p_partkey") % 7 == 6, F.concat(F.lit("油温 is "), F.col("p_size").cast("string"), F.lit(" mm"))).otherwise(text)
    return H.extract_hints(table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), text.alias("text"))).select("chunk_id", "parameter_hint", "value", "unit")


@query(
    "golden_cases",
    """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'ERROR' WHEN p_partkey % 10 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM part) SELECT status, count(*) AS cases FROM c GROUP BY 1""",
)
def golden_cases(spark, d):
    """Cases run from their text to the interval of their first number; some expect another result, some end in an error."""
    chunks, k = part_chunks(spark, d), F.col("chunk_id") % 6
    found = H.parse_operators(H.extract_hints(chunks)).where("hint_ord = 0").select(
        "chunk_id", F.concat_ws(" ", "operator", F.format_number(F.coalesce("interval.lower", F.lit(-1.0)), 6), F.format_number(F.coalesce("interval.upper", F.lit(-1.0)), 6)).alias("actual")
    )
    size = F.col("p_size").cast("double")
    low = F.when(k == 1, (size + 0.5) * 1e6).when(k == 3, size - 273.15).when(k == 4, size).when(k == 5, 0.1).otherwise(-1.0)
    high = F.when(k == 0, size / 1000).when(k == 2, size).when(k == 4, size).when(k == 5, (size + 10) / 100).otherwise(-1.0)
    operator = F.get(F.array(*[F.lit(o) for o in ("<=", ">=", "<=", ">", "==", "range")]), k.cast("int"))
    cases = chunks.select(
        "chunk_id", F.concat_ws(" ", F.when(F.col("chunk_id") % 10 == 0, "other").otherwise(operator), F.format_number(low, 6), F.format_number(high, 6)).alias("expected"),
        F.when(F.col("chunk_id") % 11 == 0, "planted").alias("error"),
    )
    return L.case_tally(cases.join(found, "chunk_id", "left"))


@query(
    "lifecycle_superseded",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) THEN 'deprecated' WHEN doc_id % 5 = 0 THEN 'transitional' WHEN doc_id % 5 = 1 THEN 'draft' ELSE 'active' END AS status,
  NOT (doc_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) OR doc_id % 5 = 1) AS binding FROM documents""",
)
def lifecycle_superseded(spark, d):
    """Documents that others replace are deprecated, whatever their text says, and no longer binding."""
    edges = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("from_doc_id"))
    docs = ST.mark_superseded(table(spark, d, "documents").select("doc_id"), edges)
    text = F.when(F.col("doc_id") % 5 == 0, "within the transition period").when(F.col("doc_id") % 5 == 1, "this draft").otherwise("as it is")
    status = S.lifecycle_status(F.array(F.lit("standard")), text, F.col("superseded"))
    return docs.select("doc_id", status.alias("status"), S.is_binding(status).alias("binding"))


@query("recall_verdicts", f"WITH r AS ({ORACLES['recall_eval']}) SELECT sum(total)::BIGINT AS total, sum(delta)::BIGINT AS delta, CASE WHEN sum(delta) > 0 THEN 'PASS' WHEN sum(delta) = 0 THEN 'NEUTRAL' ELSE 'REGRESS' END AS verdict FROM r")
def recall_verdicts(spark, d):
    """What the recall of all anchor types together says of the boost."""
    return L.recall_verdict(recall_eval(spark, d))


@query(
    "hybrid_verdicts",
    f"""WITH {CENTROIDS}, e AS (SELECT count(*) AS n FROM embeddings), h AS (SELECT top.*, em.vec_id IS NOT NULL AS good FROM top LEFT JOIN embeddings em ON em.vec_id = chunk_id AND em.label = query_id WHERE rank <= 40),
v AS (SELECT (count(*) FILTER (good AND rank <= 10 AND chunk_id % 2 = 0) - count(*) FILTER (good AND rank <= 10)) / (SELECT n FROM e)::DOUBLE * 100 AS delta FROM h)
SELECT round(delta, 6) AS delta_pct, CASE WHEN delta < -5 THEN 'HURTS' ELSE 'ACCEPTABLE' END AS verdict FROM v""",
)
def hybrid_verdicts(spark, d):
    """A second arm that finds only some of the dense hits, compared with these."""
    _, hits, expected = _recall_parts(spark, d)
    arms = hits.withColumn("arm", F.lit("dense")).unionByName(hits.where(F.col("chunk_id") % 2 == 0).withColumn("arm", F.lit("hybrid")))
    return L.hybrid_verdict(L.recall_at(expected, arms)).select(rounded("delta_pct"), "verdict")
