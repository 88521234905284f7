"""Registry of the queries on the standard tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.ansi.enabled", "false")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a file has fewer pieces than there are cores.

    A few row groups would otherwise keep most of a small machine idle in heavy row work;
    large tables have far more pieces than cores and are read as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def rounded(col: str, digits: int = 6):
    """Rounded double without negative zero."""
    return (F.round(F.col(col), digits) + F.lit(0.0)).alias(col)


# --- shapes derived from the tables, in both languages ------------------------------------------


def line_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints from lineitem: one query per order, branch by line status, parameter by flag."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linestatus").alias("branch"),
        F.col("l_returnflag").alias("parameter"),
        F.struct(
            F.when(n % 4 != 0, F.col("l_discount") * 100).alias("lower"),
            F.when(n % 3 != 0, F.col("l_quantity")).alias("upper"),
            (F.col("l_partkey") % 2 == 0).alias("lower_inclusive"),
            (F.col("l_suppkey") % 2 == 0).alias("upper_inclusive"),
        ).alias("interval"),
        F.when(n % 5 == 0, 20).when(n % 5 == 1, 100).when(n % 5 == 2, 80).when(n % 5 == 3, 60).otherwise(40).alias("level"),
        ((10 - n).cast("double") / 10).alias("confidence"),
        (n.cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("ord"),
        F.when(F.col("l_tax") < 0.04, "mm").otherwise("cm").alias("unit"),
        F.array("l_returnflag", "l_linestatus").alias("scope_path"),
        F.lit("interval").alias("value_type"),
        F.col("l_partkey").cast("string").alias("source_doc"),
    )


LINE_CONSTRAINTS = """
c AS (
  SELECT l_orderkey AS query_id, l_linestatus AS branch, l_returnflag AS parameter,
         CASE WHEN l_linenumber % 4 <> 0 THEN l_discount * 100::DOUBLE END AS lower,
         CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS upper,
         l_partkey % 2 = 0 AS lower_inc, l_suppkey % 2 = 0 AS upper_inc,
         CASE l_linenumber % 5 WHEN 0 THEN 20 WHEN 1 THEN 100 WHEN 2 THEN 80 WHEN 3 THEN 60 ELSE 40 END AS level,
         (10 - l_linenumber)::DOUBLE / 10::DOUBLE AS confidence,
         l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord,
         CASE WHEN l_tax < 0.04::DOUBLE THEN 'mm' ELSE 'cm' END AS unit,
         l_partkey
  FROM lineitem)"""

RANGES = """
s AS (SELECT *, max(lower) OVER w AS lo, min(upper) OVER w AS up FROM c WINDOW w AS (PARTITION BY query_id, branch, parameter)),
g0 AS (
  SELECT query_id, branch, parameter, count(*) AS n_applied, min(ord) AS first_ord, any_value(lo) AS lo, any_value(up) AS up,
         NOT coalesce(bool_or(lower = lo AND NOT lower_inc), false) AS lo_inc,
         NOT coalesce(bool_or(upper = up AND NOT upper_inc), false) AS up_inc,
         min(confidence) AS confidence,
         count(DISTINCT unit) > 1 AS mixed_units
  FROM s GROUP BY query_id, branch, parameter),
u AS (SELECT query_id, branch, parameter, unit FROM c
      QUALIFY row_number() OVER (PARTITION BY query_id, branch, parameter ORDER BY level, confidence, ord DESC) = 1),
g AS (SELECT g0.*, u.unit, coalesce(lo > up OR (lo = up AND NOT (lo_inc AND up_inc)), false) AS conflict
      FROM g0 JOIN u USING (query_id, branch, parameter))"""


def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per part, its text a constraint phrase that depends on the key."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    words = (
        F.when(k == 0, F.concat(F.lit("length at most "), size, F.lit(" mm")))
        .when(k == 1, F.concat(F.lit("pressure at least "), size, F.lit(".5 MPa")))
        .when(k == 2, F.concat(F.lit("温度不得超过"), size, F.lit("°C")))
        .when(k == 3, F.concat(F.lit("温度大于"), size, F.lit(" K")))
        .when(k == 4, F.concat(F.lit("掺量 is "), size, F.lit("%")))
        .otherwise(F.concat(F.lit("from 10 cm to "), (F.col("p_size") + 10).cast("string"), F.lit(" cm")))
    )
    return p.select(
        F.col("p_partkey").alias("chunk_id"),
        F.concat("p_name", F.lit(": "), words).alias("text"),
        F.array(F.when(F.col("p_type") == "ECONOMY", "national").when(F.col("p_type") == "SMALL", "industry")
                .when(F.col("p_type") == "MEDIUM", "enterprise").when(F.col("p_type") == "PROMO", "reference").otherwise("other"),
                F.col("p_brand")).alias("scope_path"),
        F.col("p_brand").alias("doc_hash"),
        F.col("p_size"), F.col("p_type"), F.col("p_name"), F.col("p_brand"),
    )


PART_CHUNKS = """
pc AS (
  SELECT p_partkey AS chunk_id, p_name, p_brand, p_size, p_type, p_partkey % 6 AS k,
         CASE p_type WHEN 'ECONOMY' THEN 'national' WHEN 'SMALL' THEN 'industry' WHEN 'MEDIUM' THEN 'enterprise'
                     WHEN 'PROMO' THEN 'reference' ELSE 'other' END AS scope0
  FROM part),
ph AS (
  SELECT *, CASE k WHEN 0 THEN '<=' WHEN 1 THEN '>=' WHEN 2 THEN '<=' WHEN 3 THEN '>' WHEN 4 THEN '==' ELSE 'range' END AS operator,
    CASE k WHEN 0 THEN 'length' WHEN 1 THEN 'pressure' WHEN 2 THEN 'temperature' WHEN 3 THEN 'temperature' WHEN 4 THEN 'percentage' ELSE 'length' END AS parameter,
    CASE k WHEN 0 THEN p_size::DOUBLE * 0.001::DOUBLE WHEN 1 THEN (p_size::DOUBLE + 0.5::DOUBLE) * 1e6::DOUBLE WHEN 2 THEN p_size::DOUBLE
           WHEN 3 THEN p_size::DOUBLE - 273.15::DOUBLE WHEN 4 THEN p_size::DOUBLE END AS norm_value,
    CASE k WHEN 0 THEN 'm' WHEN 1 THEN 'pa' WHEN 2 THEN '°C' WHEN 3 THEN '°C' WHEN 4 THEN '%' ELSE 'm' END AS norm_unit
  FROM pc)"""


def block_lines(spark: SparkSession, sf_dir: str, empty: bool = False) -> DataFrame:
    """JSON block lines of the documents, bundled by source; Spanish ones end in a torn line. With `empty`, documents without
    a text have one line, too, as an empty text has."""
    d = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit("")) if empty else F.col("text")
    lines = d.select("doc_id", "lang", "source", F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    obj = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"),
            F.lit("text").alias("type"),
            F.struct("raw").alias("content"),
            F.struct(F.array("lang", "source").alias("heading_path"), (F.col("pos") + 1).alias("page_number")).alias("metadata"),
        )
    )
    torn = (F.col("lang") == "es") & (F.col("pos") == 0)
    return lines.select(
        F.col("doc_id").cast("string").alias("bundle_id"), F.col("pos").cast("long").alias("line_no"),
        F.when(torn, F.concat(F.lit('{"doc_id": "'), F.col("doc_id").cast("string"))).otherwise(obj).alias("value"),
        "source", "lang",
    )


DOC_LINES = """
dl AS (
  SELECT doc_id, lang, source, i - 1 AS pos, lines[i] AS raw
  FROM (SELECT doc_id, lang, source, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents)))"""


def doc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def event_seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean vector of its embeddings, dimension by dimension."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = e.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("ms")).select(
        F.col("label").alias("query_id"), F.col("ms.m").alias("vector")
    )


CENTROIDS = """
ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
ce AS (SELECT label AS query_id, dim, avg(x) AS m FROM ex GROUP BY label, dim),
cn AS (SELECT query_id, sqrt(sum(m * m)) AS norm FROM ce GROUP BY query_id),
vn AS (SELECT vec_id, any_value(label) AS label, sqrt(sum(x * x)) AS norm FROM ex GROUP BY vec_id),
sim AS (SELECT ce.query_id, ex.vec_id AS chunk_id, sum(ce.m * ex.x) / any_value(cn.norm * vn.norm) AS score
        FROM ex JOIN ce USING (dim) JOIN cn USING (query_id) JOIN vn ON vn.vec_id = ex.vec_id GROUP BY ce.query_id, ex.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sim)"""
