"""The registered queries of this subpackage, each over its whole table, and SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import decontamination, hard_negatives, language, line_dedup, merkle, multi_index, pair_maxscore, quality, secrets, sentencepiece_codec, sharding, simhash, warc
from .common import id_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARDS = [f"shard-{i:03d}" for i in range(96)]


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


@query("op1_cotrained_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views and the decision for every document."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(id_of().alias("doc_id"), "content_score", "meta_score", "score", "keep")


@query("op2_simhash_trie")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(id_of().alias("doc_id"), simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query(
    "op3_suffix_line_dedup",
    rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, len(regexp_extract_all(ls[i], '[^ \t\r\x0B\f]+')) AS words
      FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS after_ FROM l),
b AS (SELECT *, after_ - words AS before_ FROM c),
w AS (SELECT *, max(pos) OVER f AS to_, max(after_) OVER f AS to_after, min(pos) OVER g AS from_, min(before_) OVER g AS from_before FROM b
      WINDOW f AS (PARTITION BY doc_id ORDER BY before_ RANGE BETWEEN 0 PRECEDING AND {line_dedup.MIN_WORDS - 1} FOLLOWING),
             g AS (PARTITION BY doc_id ORDER BY after_ RANGE BETWEEN {line_dedup.MIN_WORDS - 1} PRECEDING AND 0 FOLLOWING)),
r AS (SELECT doc_id, pos AS a, to_ AS z FROM w WHERE to_after - before_ >= {line_dedup.MIN_WORDS}
      UNION SELECT doc_id, from_, pos FROM w WHERE after_ - from_before >= {line_dedup.MIN_WORDS}),
t AS (SELECT r.doc_id, a, z, sha256(array_to_string(ls[a + 1 : z + 1], chr(10))) AS run FROM r JOIN d USING (doc_id)),
later AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, z)) AS pos FROM later),
g AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
       CASE WHEN ps IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(generate_series(1, len(ls)), lambda i: NOT list_contains(ps, i - 1)), lambda i: ls[i]), chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated line runs."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def _placement_sql() -> str:
    owners = ",".join(str(x) for x in sharding.lookup_table(SHARDS))
    return f"""
WITH t AS (SELECT [{owners}] AS owner),
s AS (SELECT doc_id, coalesce((('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT % {sharding.TABLE_SIZE})::INTEGER, 0) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner[slot + 1]::VARCHAR, 3, '0') AS shard FROM s, t"""


@query("op4_permutation_sharding", _placement_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SHARDS)


def _spans_sql(rule: secrets.Rule, i: int, pattern: str) -> str:
    return f"""
{rule.kind}0 AS (SELECT doc_id, regexp_extract_all(text, {pattern}, 1) AS m, regexp_extract_all(text, {pattern}, {rule.group}) AS v,
                        string_split_regex(text, {pattern}) AS gaps FROM docs),
{rule.kind}1 AS (SELECT doc_id, unnest(generate_series(1, len(m))) AS i, m, v, gaps FROM {rule.kind}0 WHERE len(m) > 0),
{rule.kind}2 AS (SELECT doc_id, i, length(v[i]) AS n, length(m[i]) AS size,
                        sum(length(gaps[i])) OVER w + sum(length(m[i])) OVER w - length(m[i]) AS start
                 FROM {rule.kind}1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{rule.kind} AS (SELECT doc_id, {i} AS k, start::BIGINT AS start, '{rule.kind}:' || start::BIGINT || ':' || (start + size)::BIGINT AS span
                FROM {rule.kind}2 WHERE n >= {rule.min_chars})"""


def _secrets_sql() -> str:
    letters = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    key = "|".join(letters(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = [rf"""'(({key})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))'""", "'(AKIA[A-Z0-9]+)'", "'([0-9a-f]{24,})'"]
    parts = ",".join(_spans_sql(r, i, p) for i, (r, p) in enumerate(zip(secrets.RULES, patterns)))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {parts},
every AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
               string_agg(span, ',' ORDER BY start, k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)"""


@query("op5_blob_ledger_secrets", _secrets_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of a new ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.Ledger(spark)
    ledger.update(docs)
    found = ledger.findings(docs).withColumn("spans", secrets.span_list())
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select("doc_id", *counts, F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op6_merkle_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    found = merkle.fingerprints_with_edits(table(spark, sf_dir, "documents"))
    return found.select(id_of().alias("doc_id"), *[c for c in found.columns if c != "k_id"])


@query("op7_sentencepiece_codec")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding and against the original library."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(spark, docs).drop("text")


@query("op8_byte_network_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs)
    labelled = language.identify(docs.select("doc_id", "text"), net)
    return labelled.select("doc_id", F.coalesce(language.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score", "agreement")


@query(
    "op9_warc_members",
    f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= {warc.MIN_REVISIT_BYTES} GROUP BY h)
SELECT page_id, octet_length(encode(p.h)) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the normalised archives."""
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


@query(
    "op10_winnowed_decontamination",
    r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iv AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iv),
dv AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT dv.doc_id, iv.item_id, dv.i, dv.n FROM dv JOIN iv USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that any benchmark item shares."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        id_of().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op11_angular_hard_negatives",
    """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
      FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of every anchor."""
    return hard_negatives.mine_embeddings(table(spark, sf_dir, "embeddings"))


@query("op12_multi_index_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose id is divisible by 20."""
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op13_pair_maxscore",
    r"""
WITH low AS (SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
             UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM low),
d AS (SELECT id AS doc_id, ws, len(ws) AS n FROM w WHERE side = 'd' AND len(ws) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
i AS (SELECT DISTINCT id AS item_id, unnest(ws) AS term FROM w WHERE side = 'i'),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN wt USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    found = pair_maxscore.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
