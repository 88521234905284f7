"""Parsed-document bundles: JSON block lines, index files, classification, corpus selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators.scan import numbered

BLOCK_SCHEMA = """doc_id STRING, block_id STRING, type STRING,
    content STRUCT<raw: STRING, md_preview: STRING, structured: ARRAY<ARRAY<STRING>>, formulas: STRING>,
    metadata STRUCT<page_number: INT, bbox: ARRAY<DOUBLE>, heading_path: ARRAY<STRING>,
                    form_fields: ARRAY<MAP<STRING, STRING>>,
                    column_headers: ARRAY<STRUCT<index: INT, header: STRING>>>,
    lineage STRUCT<parser_version: STRING, strategy: STRING, steps: ARRAY<STRING>>,
    uncertainty_score DOUBLE"""
_READ_SCHEMA = BLOCK_SCHEMA.replace("raw: STRING", "raw: VARIANT") + ", _corrupt STRING"
BLOCK_TYPES = ["header", "text", "table", "kv", "attachment_ref"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with file, position inside the file, and text.

    A file may be read by several tasks; lines are numbered within their piece and shifted
    by the pieces before, so no file has to fit one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    return raw


def number_lines(raw: DataFrame) -> DataFrame:
    """Add line_no (0-based) per file to the output of read_lines."""
    out = numbered(raw, ["file"], [F.col("piece"), F.col("seq")], "_n")
    return out.select("file", (F.col("_n") - 1).alias("line_no"), "value")


def number_read_lines(stored: DataFrame) -> DataFrame:
    """As number_lines, for stored rows that are all rows of their files as they were read, with their first ids.

    A task reads a piece of a file in one go, so ids of a piece have no gaps: only counts of pieces are added up, and no
    line is moved or sorted.
    """
    pieces = stored.groupBy("file", "piece").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("file", "piece", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = stored.join(F.broadcast(pieces), ["file", "piece"])  # one row for each piece of spark.sql.files.maxPartitionBytes
    return out.select("file", (F.col("seq") + F.col("_shift")).alias("line_no"), "value")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Blocks from JSON lines: adds the block columns and bad (true for a rejected line).

    Blank lines are dropped. A line is rejected when it is not a JSON object, lacks doc_id,
    block_id or type, names an unknown type, or holds a raw content that is not text.
    """
    text = F.btrim(line, F.lit(K.SPACES))
    parsed = F.from_json(text, _READ_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # the outer generator holds the parsed line, so later columns and filters do not parse again
    out = lines.where(text != "").select("*", F.explode_outer(F.array(parsed)).alias("b"))
    has = lambda f: F.col(f"b.{f}").isNotNull()
    kind = F.schema_of_variant(F.col("b.content.raw"))
    bad = (
        F.col("b").isNull()
        | has("_corrupt")
        | ~(has("doc_id") & has("block_id") & has("type"))
        | ~F.coalesce(F.col("b.type").isin(*BLOCK_TYPES), F.lit(False))
        | ~F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))
        | F.coalesce(F.col("b.metadata.page_number") < 1, F.lit(False))
    )
    content = F.struct(
        F.coalesce(F.try_variant_get("b.content.raw", "$", "string"), F.lit("")).alias("raw"),
        F.coalesce("b.content.md_preview", F.lit("")).alias("md_preview"),
        F.col("b.content.structured").alias("structured"),
        F.col("b.content.formulas").alias("formulas"),
    )
    return out.select(
        *lines.columns, F.coalesce(bad, F.lit(True)).alias("bad"), "b.doc_id", "b.block_id", "b.type",
        content.alias("content"), "b.metadata", "b.lineage", "b.uncertainty_score",
    )


def split_documents(parsed: DataFrame, bundle: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of bundles without a bad line, and the bundles that one bad line rejects."""
    failed = parsed.where("bad").select(bundle).distinct()
    return parsed.where(~F.col("bad")).join(failed, bundle, "left_anti").drop("bad"), failed


def block_facts(blocks: DataFrame) -> DataFrame:
    """Text and metadata of a block as chunking sees them."""
    return blocks.select(
        "doc_id", "block_id", "type",
        F.col("metadata.page_number").alias("page_number"),
        F.coalesce("metadata.heading_path", F.array().cast("array<string>")).alias("heading_path"),
        X.block_text(F.col("content.md_preview"), F.col("content.raw")).alias("text"),
    )


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def write_index_files(files: DataFrame, path: str, bundle: str = "bundle_id") -> None:
    """One index file in each bundle's folder. Bundles are dealt over all cores, as files cost more than their bytes, and
    tasks put their own files in place."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    dealt = files.repartition(max(4 * cores, files.rdd.getNumPartitions()), bundle)
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(bundle).text(path)


def read_index_names(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """bundle_id and file_name from each bundle's index file; null when corrupt or missing.

    path is the folder of the bundles, whose folders are then listed by tasks, or a pattern; names, that of the files.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))  # else a task for each folder
    try:
        files = found.text(path, wholetext=True)
    finally:
        spark.conf.set(LISTING, before) if before else spark.conf.unset(LISTING)
    raw = files.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("bundle_id"), "value"
    )
    return raw.select("bundle_id", F.nullif(F.get_json_object("value", "$.file_name"), F.lit("")).alias("file_name"))


# --- classification ---------------------------------------------------------------------------


def load_rules(spark: SparkSession, path: str | None = None) -> tuple[list[tuple[str, str, int]], tuple[str, int]]:
    """Ordered rules and the default, from a JSON file or the built-in list.

    Bad patterns and priorities outside 0..100 fail here, not inside a job.
    """
    rules, default = K.DOC_TYPE_RULES, K.DOC_TYPE_DEFAULT
    if path:
        row = spark.read.option("multiLine", True).schema(
            "rules ARRAY<STRUCT<pattern: STRING, doc_type: STRING, priority: INT>>, default STRUCT<doc_type: STRING, priority: INT>"
        ).json(path).first()
        rules = [(r.pattern, r.doc_type, r.priority) for r in row.rules]
        default = (row.default.doc_type, row.default.priority)
    for pattern, _, priority in [*rules, (".", *default)]:
        if not 0 <= priority <= 100:
            raise ValueError(f"priority outside 0..100: {priority}")
        re.compile(pattern)
        spark.range(1).select(F.lit("").rlike(f"(?i){pattern}")).first()
    return rules, default


def classify(file_name: Column, rules=None, default=None) -> Column:
    """STRUCT<doc_type, priority> of the first matching rule; blank names get the default."""
    rules, default = rules or K.DOC_TYPE_RULES, default or K.DOC_TYPE_DEFAULT
    result = lambda t, p: F.struct(F.lit(t).alias("doc_type"), F.lit(p).alias("priority"))
    chain = F.when(F.coalesce(file_name, F.lit("")) == "", result(*default))
    for pattern, doc_type, priority in rules:
        chain = chain.when(file_name.rlike(f"(?i){pattern}"), result(doc_type, priority))
    return chain.otherwise(result(*default))


# --- choosing bundles ---------------------------------------------------------------------------


def bundle_totals(lines: DataFrame, bundle: str = "bundle_id", line: str = "value") -> DataFrame:
    """Blocks (malformed lines included), raw characters (text only) and content flag per bundle."""
    doc = F.try_parse_json(line)
    raw = F.try_variant_get(doc, "$.content.raw", "variant")
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(doc, "$.content.raw", "string"))
    whole = F.try_variant_get(doc, "$.content", "variant")
    direct = F.when(F.schema_of_variant(whole) == "STRING", F.try_variant_get(doc, "$.content", "string"))
    rows = lines.where(F.btrim(line, F.lit(K.SPACES)) != "").select(bundle, text.alias("t"), F.coalesce(text, direct).alias("any"))
    return rows.groupBy(bundle).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("raw_chars"),
        F.bool_or(F.coalesce(F.btrim("any", F.lit(K.SPACES)) != "", F.lit(False))).alias("has_content"),
    )


def pick_bundles(totals: DataFrame, n: int, min_blocks: int = 0, max_blocks: int = 0, require_content: bool = True) -> DataFrame:
    """The n smallest bundles inside the block range (max 0 = no limit)."""
    rows = totals.where(F.col("n_blocks") >= min_blocks)
    if max_blocks > 0:
        rows = rows.where(F.col("n_blocks") <= max_blocks)
    if require_content:
        rows = rows.where("has_content")
    return rows.orderBy("n_blocks", "bundle_id").limit(n)


def first_bundles(lines: DataFrame, n: int, bundle: str = "bundle_id", line: str = "value") -> DataFrame:
    """First n bundles by name with at least one readable line; unreadable lines are skipped."""
    good = lines.where(F.try_parse_json(line).isNotNull())
    return good.groupBy(bundle).agg(F.count(F.lit(1)).alias("n_blocks")).orderBy(bundle).limit(n)


def status_timeout(raw_chars: Column) -> Column:
    chunks = F.greatest(F.lit(1), F.floor(raw_chars / K.CHARS_PER_ESTIMATED_CHUNK))
    return F.greatest(F.lit(K.STATUS_TIMEOUT_S), chunks * K.SECONDS_PER_ESTIMATED_CHUNK)
