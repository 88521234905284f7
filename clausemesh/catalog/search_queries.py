"""Chunking, identifiers and retrieval."""

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import ids
from ..functions import scope as S
from ..functions import text as X
from ..functions import tokens as TK
from ..operators import chunking as CH
from ..operators import retrieval as R
from ..operators import stats as SX
from ..plans import answer as A
from ..session import cut_lineage
from .base import CENTROIDS, DOC_LINES, PART_CHUNKS, centroids, doc_corpus, documents, part_chunks, query, rounded, table


def doc_chunks(spark, d, budget=K.MAX_CHUNK_TOKENS):
    docs = documents(spark, d)
    return CH.chunk_texts(
        docs, F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit("unknown"), F.array("lang", "source"), F.col("text"), budget
    )


_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_SAFE = r"\s\x1C-\x1F\x0B.,;:!?()\[\]{}\"''\-/\\|<>=+*&%@#$^_~`\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
_GLUED = "^([0-9][A-Za-z.]|[A-Za-z][0-9]|[.][0-9]|[A-Za-z][A-Za-z])$"


def cut_sql(p: str, source: str, limit: int, budget: int) -> str:
    """CTEs that cut the texts of a relation (id, text) into pieces, a step of the recursion for each, and merge pieces
    left to right: {p}t (id, g, piece) with g counting from 1."""
    return rf"""
{p}c AS (SELECT id, text, length(text)::BIGINT AS n, 0::BIGINT AS start, 0::BIGINT AS stop, 0::BIGINT AS i FROM {source}
  UNION ALL
  SELECT id, text, n, stop, CASE WHEN inside AND target > stop THEN target ELSE e END, i + 1
  FROM (SELECT *, CASE WHEN substr(text, e, 1) SIMILAR TO '[0-9.]' AND other + 1 < e AND regexp_matches(substr(text, other + 1, 1), '[{_SAFE}]') THEN other + 1
                       WHEN loose < e - f THEN e - loose ELSE e END AS target
        FROM (SELECT *, greatest(e - 1 - length(regexp_extract(back, '[0-9.]*$')), f) AS other, length(regexp_extract(back, '[^{_SAFE}]*$')) AS loose
              FROM (SELECT *, substr(text, f + 1, e - f) AS back
                    FROM (SELECT *, e < n AND stop + 1 < e AND n > {limit} AND regexp_matches(substr(text, e, 2), '^([0-9A-Za-z][0-9A-Za-z]|[0-9][.]|[.][0-9])$') AS inside,
                                 greatest(0, e - greatest(8, floor(e * 0.2)::BIGINT)) AS f
                          FROM (SELECT *, least(stop + {limit}, n) AS e FROM {p}c WHERE stop < n)))))),
{p}f AS (SELECT id, piece, greatest(1, length(piece) // 4) AS tok, row_number() OVER (PARTITION BY id ORDER BY i) AS k
  FROM (SELECT id, i, substr(text, start + 1, stop - start) AS piece FROM {p}c WHERE i > 0) WHERE trim(piece, {_BLANK}) <> ''),
{p}m AS (SELECT id, k, piece, tok AS acc, 1::BIGINT AS g FROM {p}f WHERE k = 1
  UNION ALL
  SELECT f.id, f.k, f.piece, CASE WHEN NOT regexp_matches(right(m.piece, 1) || left(f.piece, 1), '{_GLUED}') AND m.acc + f.tok <= {budget} THEN m.acc + f.tok ELSE f.tok END,
    CASE WHEN NOT regexp_matches(right(m.piece, 1) || left(f.piece, 1), '{_GLUED}') AND m.acc + f.tok <= {budget} THEN m.g ELSE m.g + 1 END
  FROM {p}m m JOIN {p}f f ON f.id = m.id AND f.k = m.k + 1),
{p}t AS (SELECT id, g, string_agg(piece, '' ORDER BY k) AS piece FROM {p}m GROUP BY id, g)"""


def doc_chunks_sql(budget: int = K.MAX_CHUNK_TOKENS) -> str:
    """CTEs up to dc (doc_id, doc_hash, chunk_index, text, token_count, n_blocks): the documents' chunks, a block per line."""
    return f"""{DOC_LINES}, b AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
   greatest(1, length(raw) // 4) AS tok FROM dl WHERE raw <> ''),
w AS (SELECT doc_id, i, n, tok, tok AS acc, i AS key FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, b.n, b.tok, CASE WHEN w.tok > {budget} OR w.acc + b.tok > {budget} THEN b.tok ELSE w.acc + b.tok END,
    CASE WHEN w.tok > {budget} OR w.acc + b.tok > {budget} THEN b.i ELSE w.key END FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1),
gl AS (SELECT w.doc_id, w.key, w.i, w.n, w.tok, b.raw, coalesce(regexp_matches(right(lag(b.raw) OVER p, 1) || left(b.raw, 1), '{_GLUED}'), false) AS glued
  FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i WINDOW p AS (PARTITION BY w.doc_id, w.key ORDER BY w.i)),
gr AS (SELECT doc_id, key, count(*) AS n_blocks, string_agg(raw, chr(10) ORDER BY i) AS whole, bool_or(glued) AS glued,
    CASE WHEN max(tok) > {budget} THEN 'split' WHEN max(i) = any_value(n) - 1 THEN 'flush' ELSE 'route' END AS kind FROM gl GROUP BY doc_id, key),
gk AS (SELECT *, kind = 'split' OR (kind = 'route' AND (glued OR greatest(1, length(whole) // 4) > {budget})) AS cut FROM gr),
ln AS (SELECT doc_id, key, n_blocks, i, string_split(whole, chr(10))[i] AS line FROM (SELECT *, unnest(generate_series(1, len(string_split(whole, chr(10))))) AS i FROM gk WHERE cut)),
lo AS (SELECT doc_id::VARCHAR || ' ' || key::VARCHAR || ' ' || i::VARCHAR AS id, line AS text FROM ln WHERE length(line) > {budget * 4}),
{cut_sql('x', 'lo', budget * 4, budget)},
ch AS (SELECT doc_id, key, 0::BIGINT AS i, 0::BIGINT AS g, n_blocks, trim(whole, {_BLANK}) AS text FROM gk WHERE NOT cut AND trim(whole, {_BLANK}) <> ''
  UNION ALL SELECT doc_id, key, i, 0, n_blocks, line FROM ln WHERE length(line) <= {budget * 4} AND trim(line, {_BLANK}) <> ''
  UNION ALL SELECT doc_id, key, i, g, n_blocks, piece FROM ln JOIN xt ON xt.id = doc_id::VARCHAR || ' ' || key::VARCHAR || ' ' || i::VARCHAR),
dc AS (SELECT doc_id, md5(doc_id::VARCHAR) AS doc_hash, row_number() OVER (PARTITION BY doc_id ORDER BY key, i, g) - 1 AS chunk_index, text,
    greatest(1, length(text) // 4) AS token_count, n_blocks FROM ch)"""


@query(
    "chunk_documents",
    f"""WITH RECURSIVE {doc_chunks_sql()}
SELECT doc_hash, chunk_index, substr(doc_hash, 1, 8) || '-' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id, md5(text) AS text_md5, token_count, n_blocks FROM dc""",
)
def chunk_documents(spark, d):
    """Scope-aware chunks of all documents, a block per line."""
    c = doc_chunks(spark, d)
    return c.select("doc_hash", "chunk_index", "chunk_id", F.md5("text").alias("text_md5"), "token_count", F.size("source_block_ids").alias("n_blocks"))


@query(
    "chunk_packs",
    f"""WITH RECURSIVE {DOC_LINES}, b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
   greatest(1, length(raw) // 4) AS tok FROM dl WHERE raw <> ''),
w AS (SELECT doc_id, i, n, tok, tok AS acc, i AS key FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, b.n, b.tok, CASE WHEN w.tok > 768 OR w.acc + b.tok > 768 THEN b.tok ELSE w.acc + b.tok END,
    CASE WHEN w.tok > 768 OR w.acc + b.tok > 768 THEN b.i ELSE w.key END FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
SELECT md5(doc_id::VARCHAR) AS doc_hash, key, count(*) AS n_blocks, CASE WHEN max(tok) > 768 THEN 'split' WHEN max(i) = any_value(n) - 1 THEN 'flush' ELSE 'route' END AS kind
FROM w GROUP BY doc_id, key""",
)
def chunk_packs(spark, d):
    """Greedy packing of each document's lines under the token budget, before texts are built."""
    docs = documents(spark, d)
    units = CH.units_from_texts(
        docs, F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit("unknown"), F.array("lang", "source"), F.col("text")
    )
    packs = CH.pack_units(units).select("doc_hash", F.explode_outer("packs").alias("p")).where(F.col("p").isNotNull())
    return packs.select("doc_hash", "p.key", F.size("p.blocks").cast("long").alias("n_blocks"), "p.kind")


@query(
    "chunk_loss_free",
    r"""SELECT md5(doc_id::VARCHAR) AS doc_hash, length(regexp_replace(text, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS solid_chars,
  true AS within_budget FROM documents WHERE text <> ''""",
)
def chunk_loss_free(spark, d):
    """Characters other than white space are all kept, and no chunk exceeds the budget
    by more than what rounding down per block hides."""
    solid = F.length(F.regexp_replace("text", K.SPACE, ""))
    return doc_chunks(spark, d).groupBy("doc_hash").agg(
        F.sum(solid).alias("solid_chars"), (F.max(F.col("token_count") - F.size("source_block_ids")) <= K.MAX_CHUNK_TOKENS).alias("within_budget")
    )


@query(
    "chunk_short_documents",
    r"""SELECT md5(doc_id::VARCHAR) AS doc_hash, md5(trim(text, chr(10) || chr(13) || chr(9) || ' ')) AS text_md5, greatest(1, length(trim(text, chr(10) || chr(13) || chr(9) || ' ')) // 4)::BIGINT AS token_count
  FROM (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS text FROM documents) WHERE length(text) // 4 <= 760 AND length(text) > 0""",
)
def chunk_short_documents(spark, d):
    """A document that fits the budget is one chunk: its non-empty lines."""
    docs = documents(spark, d)
    joined = F.array_join(F.filter(F.split("text", "\n"), lambda x: x != ""), "\n")
    fits = docs.withColumn("_j", joined).where((F.floor(F.length("_j") / 4) <= 760) & (F.length("_j") > 0))
    c = CH.chunk_texts(fits, F.md5(F.col("doc_id").cast("string")), F.lit(1), F.lit("unknown"), F.array("lang", "source"), F.col("text"))
    return c.select("doc_hash", F.md5("text").alias("text_md5"), F.col("token_count").cast("long").alias("token_count"))


@query(
    "chunk_budget",
    f"""WITH RECURSIVE {doc_chunks_sql(200)}, pd AS (SELECT doc_hash, count(*) AS n, count(*) FILTER (token_count > 200) AS over FROM dc GROUP BY 1)
SELECT count(*) AS n_docs, sum(n)::BIGINT AS total_chunks, avg(n) AS avg_chunks, sum(over)::BIGINT AS violations FROM pd""",
)
def chunk_budget(spark, d):
    return SX.chunk_budget(doc_chunks(spark, d, 200), 200)


@query(
    "chunk_spread",
    f"""WITH RECURSIVE {doc_chunks_sql()}, pd AS (SELECT count(*) AS n FROM dc GROUP BY doc_id HAVING count(*) > 1),
ls AS (SELECT list_sort(list(n)) AS v, count(*) AS n FROM pd)
SELECT v[1]::DOUBLE AS smallest, v[greatest(1, floor(0.5::DOUBLE * n))::BIGINT]::DOUBLE AS median, v[greatest(1, floor(0.99::DOUBLE * n))::BIGINT]::DOUBLE AS p99, v[n]::DOUBLE AS largest, n FROM ls""",
)
def chunk_spread(spark, d):
    """Spread of chunks per document."""
    return SX.chunk_spread(doc_chunks(spark, d))


@query(
    "chunk_id_collisions",
    f"WITH RECURSIVE {doc_chunks_sql()} SELECT substr(doc_hash, 1, 2) || '-' || lpad(chunk_index::VARCHAR, 4, '0') AS chunk_id, count(*) AS n FROM dc GROUP BY 1 HAVING count(*) > 1",
)
def chunk_id_collisions(spark, d):
    """Identifiers that name several chunks, if they had only two characters of the document's hash."""
    short = F.concat(F.substring("chunk_id", 1, 2), F.substring("chunk_id", 9, 5))
    return SX.id_collisions(doc_chunks(spark, d).select(short.alias("chunk_id")))


@query(
    "chunk_boundaries",
    f"""WITH RECURSIVE {doc_chunks_sql()}
SELECT a.doc_hash, a.chunk_index, NOT regexp_matches(right(a.text, 1) || left(b.text, 1), '{_GLUED}') AS safe
FROM dc a JOIN dc b ON b.doc_id = a.doc_id AND b.chunk_index = a.chunk_index + 1""",
)
def chunk_boundaries(spark, d):
    """Whether neighbouring chunks of a document could be joined, by an equi-join on position."""
    c = doc_chunks(spark, d).select("doc_hash", "chunk_index", "text")
    nxt = c.select("doc_hash", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("text").alias("next_text"))
    return c.join(nxt, ["doc_hash", "chunk_index"]).select(
        "doc_hash", "chunk_index", X.safe_join(F.col("text"), F.col("next_text")).alias("safe")
    )


@query(
    "doc_doc_types",
    f"""WITH RECURSIVE {doc_chunks_sql()} SELECT lang AS doc_type, count(DISTINCT dc.doc_id) AS n_docs, count(*) AS n_chunks FROM dc JOIN documents d ON d.doc_id = dc.doc_id GROUP BY lang""",
)
def doc_doc_types(spark, d):
    """Distribution of document types over the chunks of ingested documents."""
    chunks = doc_chunks(spark, d).withColumn("doc_type", F.get("scope_path", F.lit(0)))
    return chunks.groupBy("doc_type").agg(F.count_distinct("doc_hash").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"))


@query(
    "line_joins",
    rf"""WITH {DOC_LINES}, j AS (SELECT doc_id, pos, raw, lead(raw) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS np FROM dl)
SELECT doc_id, pos::BIGINT AS pos, NOT coalesce(regexp_matches(right(raw, 1) || left(nxt, 1), '^([0-9][A-Za-z.]|[A-Za-z][0-9]|[.][0-9]|[A-Za-z][A-Za-z])$'), false) AS safe FROM j WHERE np IS NOT NULL""",
)
def line_joins(spark, d):
    """Safe-join test of neighbouring lines."""
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    nxt = lines.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("raw").alias("nxt"))
    j = lines.join(nxt, ["doc_id", "pos"])
    safe = F.when((F.col("raw") == "") | (F.col("nxt") == ""), F.lit(True)).otherwise(X.safe_join(F.col("raw"), F.col("nxt")))
    return j.select("doc_id", F.col("pos").cast("long").alias("pos"), safe.alias("safe"))


@query(
    "split_by_tokens",
    f"""WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {cut_sql('x', 'src', 400, 100)}
SELECT doc_id, count(piece) AS n_pieces, md5(coalesce(string_agg(piece, '|' ORDER BY g), '')) AS pieces_md5 FROM documents LEFT JOIN xt ON id = doc_id GROUP BY doc_id""",
)
def split_by_tokens(spark, d):
    """Two-phase split of every document text as one string."""
    docs = documents(spark, d).select("doc_id", X.split_by_tokens(F.col("text"), 100).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "|")).alias("pieces_md5"))


@query(
    "split_is_loss_free",
    "SELECT doc_id, length(text) AS n_chars, true AS bounded FROM documents",
)
def split_is_loss_free(spark, d):
    """Pieces put together give all but the white space of the text back, each within the limit; a blank text has none."""
    solid = lambda c: F.translate(F.coalesce(c, F.lit("")), K.SPACES, "")
    docs = documents(spark, d).select("doc_id", "text", X.split_by_tokens(F.col("text"), 100).alias("p"))
    return docs.select(
        "doc_id",
        F.when(solid(F.array_join("p", "")) == solid(F.col("text")), F.length("text")).otherwise(-1).cast("long").alias("n_chars"),
        F.forall("p", lambda s: F.length(s) <= 440).alias("bounded"),
    )


@query(
    "table_headers",
    """SELECT p_partkey AS part_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '/' || p_type ELSE p_name || '/' || p_type END AS headers FROM part""",
)
def table_headers(spark, d):
    """Column headers from structured rows, else from the Markdown header row."""
    even = F.col("p_partkey") % 2 == 0
    structured = F.when(even, F.array(F.array("p_brand", F.lit(""), "p_type"), F.array("p_name")))
    md = F.concat(F.lit("title\n|---|---|\n| "), "p_name", F.lit(" |  | "), "p_type", F.lit(" |\n| a | b |"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.array_join(X.table_headers(structured, md), "/").alias("headers"))


@query("table_chunks")
def table_chunks(spark, d):
    """Orders of each customer as one table block, split by rows under a small budget."""
    o = table(spark, d, "orders")
    seg = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    lists = o.join(seg, "o_custkey").groupBy("o_custkey", "c_mktsegment").agg(
        F.sort_array(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))).alias("rows")
    )
    structured = F.concat(F.array(F.array(F.lit("order"), F.lit("status"), F.lit("priority"))), F.col("rows"))
    blocks = lists.select(
        F.col("o_custkey").cast("string").alias("doc_hash"), F.lit(1).alias("version"), F.lit("unknown").alias("doc_type"), F.lit(0).cast("long").alias("block_ord"),
        F.lit("t0").alias("block_id"), F.lit("table").alias("type"),
        F.struct(
            F.array("c_mktsegment").alias("heading_path"), F.lit(1).alias("page_number"), F.lit(None).cast("array<map<string,string>>").alias("form_fields"),
            F.lit(None).cast("array<struct<index:int,header:string>>").alias("column_headers"),
        ).alias("metadata"),
        F.struct(F.array_join(F.transform(structured, lambda r: F.array_join(r, " ")), "\n").alias("raw"), F.lit("").alias("md_preview"), structured.alias("structured")).alias("content"),
    )
    c = CH.chunk_blocks(blocks, 24)
    return c.select("doc_hash", "chunk_index", "token_count", "quality_warning", F.md5("text").alias("text_md5"))


# --- identifiers --------------------------------------------------------------------------------------


@query(
    "document_ids",
    """SELECT doc_id, md5('t' || doc_id::VARCHAR || '|' || md5(text) || '|1') AS request_id, sha256(text) || '|m1' AS cache_key,
  substring(md5(text), 1, 8) || '-' || lpad((doc_id % 10000)::VARCHAR, 4, '0') AS chunk_id, (doc_id % 10000)::INTEGER AS chunk_index,
  regexp_replace('d' || doc_id::VARCHAR || '_r20260728T045717Z', '_r\\d{8}T\\d{6}Z$', '') AS base_id FROM documents""",
)
def document_ids(spark, d):
    n = (F.col("doc_id") % 10000).cast("int")
    cid = ids.chunk_id(F.md5("text"), n)
    return documents(spark, d).select(
        "doc_id", ids.request_id(F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.md5("text"), F.lit(1)).alias("request_id"),
        ids.cache_key(F.col("text"), F.lit("m1")).alias("cache_key"), cid.alias("chunk_id"), ids.chunk_index(cid).alias("chunk_index"),
        ids.strip_run_suffix(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_r20260728T045717Z"))).alias("base_id"),
    )


UUID_SQL = """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('d' || doc_id::VARCHAR || ':1:c')::BLOB) AS h FROM documents)
SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
  substring('89ab', (strpos('0123456789abcdef', substring(h, 17, 1)) - 1)::INTEGER % 4 + 1, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id FROM h"""


@query("point_ids", UUID_SQL)
def point_ids(spark, d):
    return documents(spark, d).select(
        "doc_id", ids.point_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit(1), F.lit("c")).alias("point_id")
    )


@query(
    "chunk_keys",
    "SELECT p_partkey AS part_id, CASE WHEN p_partkey % 2 = 0 THEN 'c' || p_partkey::VARCHAR ELSE p_brand || ':' || p_name END AS key FROM part",
)
def chunk_keys(spark, d):
    cid = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"), ids.chunk_key(cid, F.col("p_brand"), F.array("p_name", F.lit("x"))).alias("key")
    )


@query(
    "lot_labels",
    "SELECT p_partkey AS part_id, CASE WHEN p_partkey % 3 = 0 THEN 'Lot ' || p_size::VARCHAR END AS lot FROM part",
)
def lot_labels(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("7-LOT 00"), F.col("p_size").cast("string"), F.lit(" NCR.doc"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), ids.lot_label(name).alias("lot"))


# --- scopes ---------------------------------------------------------------------------------------------


@query(
    "scope_filters",
    """SELECT doc_id, lang = 'en' AS retrieval_broad, lang = 'en' AND source = 'src1' AS retrieval_exact, lang = 'en' AS solver_side,
  lang || ' ' || source AS scope_text FROM documents""",
)
def scope_filters(spark, d):
    """Both scope tests: active prefix of chunk, and chunk prefix of active."""
    scope = F.array("lang", "source")
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    return documents(spark, d).select(
        "doc_id", S.chunk_in_scope(scope, arr("en")).alias("retrieval_broad"), S.chunk_in_scope(scope, arr("en", "src1")).alias("retrieval_exact"),
        S.constraint_in_scope(F.array("lang"), arr("en", "src1")).alias("solver_side"), S.scope_text(scope).alias("scope_text"),
    )


@query(
    "scope_scores",
    """SELECT p_partkey AS part_id,
  greatest(CASE WHEN p_partkey % 2 = 0 THEN 0.8::DOUBLE ELSE CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'SMALL' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 WHEN 'PROMO' THEN 0.2 ELSE 0.4 END::DOUBLE END,
           CASE WHEN p_size > 40 THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN p_size > 20 THEN 0.7::DOUBLE ELSE 0 END) AS score,
  CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'SMALL' THEN 0.8 WHEN 'MEDIUM' THEN 0.6 WHEN 'PROMO' THEN 0.2 ELSE 0.0 END::DOUBLE AS label_score FROM part""",
)
def scope_scores(spark, d):
    c = part_chunks(spark, d)
    doc_type = F.when(F.col("chunk_id") % 2 == 0, "industry_standard")
    return c.select(
        F.col("chunk_id").alias("part_id"),
        S.scope_score(doc_type, F.col("scope_path"), F.col("p_size") > 40, F.col("p_size") > 20).alias("score"),
        S.label_score(F.col("scope_path")).alias("label_score"),
    )


# --- vectors ---------------------------------------------------------------------------------------------


@query("cosine_topk", f"WITH {CENTROIDS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top WHERE rank <= 40")
def cosine_topk(spark, d):
    """The 40 nearest vectors to every label's mean vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.dense_topk(centroids(spark, d), e).select("query_id", "chunk_id", rounded("score"), F.col("rank").cast("long").alias("rank"))


@query("cosine_threshold", f"WITH {CENTROIDS} SELECT query_id, chunk_id FROM top WHERE rank <= 40 AND score >= 0.3")
def cosine_threshold(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.dense_topk(centroids(spark, d), e, score_threshold=0.3).select("query_id", "chunk_id")


@query(
    "l2_normalize",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9) AS norm FROM e)
SELECT vec_id, round(v[1] / norm, 6) AS first, round(list_max(v) / norm, 6) AS largest FROM n""",
)
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", R.l2_normalize(F.col("embedding").cast("array<double>")).alias("v"))
    return e.select("vec_id", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.array_max("v"), 6) + 0.0).alias("largest"))


SPARSE = """
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY doc_id, word),
qw AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY item_id, word),
sd AS (SELECT item_id AS query_id, doc_id AS chunk_id, sum(w.n * qw.n)::DOUBLE AS score FROM w JOIN qw USING (word) GROUP BY 1, 2),
st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sd)"""


def _words(df, key, name):
    """Every word of a text, in an array."""
    return df.select(F.col(key).alias(name), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("terms"))


def _sparse_hits(spark, d):
    q = _words(table(spark, d, "benchmark"), "item_id", "query_id").select("query_id", F.explode("terms").alias("term"))
    q = q.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return R.sparse_topk(q, _words(documents(spark, d), "doc_id", "chunk_id"))


@query("sparse_dot", f"WITH {SPARSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM st WHERE rank <= 40")
def sparse_dot(spark, d):
    """Sparse dot product of benchmark and document term weights."""
    return _sparse_hits(spark, d).select("query_id", "chunk_id", rounded("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "sparse_weights",
    """SELECT l_orderkey AS text_id, l_partkey % 97 AS term, round(greatest(0, max_by(l_discount - 0.05::DOUBLE, l_linenumber::BIGINT * 1000000000 + l_extendedprice * 100)), 6) AS weight
FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 97 NOT IN (0, 1, 2) GROUP BY 1, 2""",
)
def sparse_weights(spark, d):
    """Term weights from token rows: negatives cut, specials and padding out, last one counts."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("text_id"), (F.col("l_partkey") % 97).alias("term"), (F.col("l_returnflag") == "R").alias("is_padding"),
        (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_extendedprice") * 100).alias("pos"), (F.col("l_discount") - 0.05).alias("imp"),
    )
    return R.sparse_weights(li, "text_id", F.col("imp"), [0, 1, 2]).select("text_id", "term", rounded("weight"))


VECTORS = """
lv AS (SELECT doc_id AS chunk_id, list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE) AS v FROM documents),
qv AS (SELECT item_id AS query_id, list_transform(range(97, 123), lambda c: (length(lower(text)) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE) AS v FROM benchmark),
dv AS (SELECT query_id, chunk_id, list_dot_product(qv.v, lv.v) / (greatest(sqrt(list_dot_product(qv.v, qv.v)), 1e-9) * greatest(sqrt(list_dot_product(lv.v, lv.v)), 1e-9)) AS score FROM qv, lv),
dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dv)"""


def _letters(df, key, name):
    """Counts of the letters a to z as a vector."""
    low = F.lower("text")
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)]
    return df.select(F.col(key).alias(name), F.array(*counts).alias("vector"))


def _dense_hits(spark, d):
    return R.dense_topk(_letters(table(spark, d, "benchmark"), "item_id", "query_id"), _letters(documents(spark, d), "doc_id", "chunk_id"))


@query(
    "hybrid_vector_topk",
    f"""WITH {SPARSE}, {VECTORS},
vl AS (SELECT query_id, 0 AS list_id, chunk_id AS key, rank AS pos FROM dt WHERE rank <= 40 UNION ALL SELECT query_id, 1, chunk_id, rank FROM st WHERE rank <= 40),
vf AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + pos)) AS score, min(list_id * 1000000000000 + pos) AS seen FROM vl GROUP BY 1, 2),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM vf)
SELECT query_id, key AS chunk_id, round(score, 9) AS score, rank FROM vr WHERE rank <= 40""",
)
def hybrid_vector_topk(spark, d):
    """Dense and sparse candidates fused into one vector list."""
    hits = R.hybrid_vector_topk(_dense_hits(spark, d), _sparse_hits(spark, d))
    return hits.select("query_id", "chunk_id", rounded("score", 9), F.col("rank").cast("long").alias("rank"))


# --- full text ---------------------------------------------------------------------------------------------

FTS = r"""
tok AS (SELECT doc_id AS chunk_id, t AS word FROM (SELECT doc_id, unnest(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE t <> ''),
len AS (SELECT d.doc_id AS chunk_id, count(word)::DOUBLE AS dl FROM documents d LEFT JOIN tok ON tok.chunk_id = d.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n_rows, avg(dl) AS avg_len FROM len),
tf AS (SELECT chunk_id, word, count(*) AS n FROM tok GROUP BY chunk_id, word),
qt AS (SELECT item_id AS query_id, i AS pos, trim(lower(strip_accents(regexp_replace(ws[i], '[^\p{L}\p{N}]+', ' ', 'g')))) AS phrase
       FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark))),
q1 AS (SELECT * FROM qt WHERE phrase <> ''),
vocab AS (SELECT DISTINCT word FROM tf),
pre AS (SELECT p.phrase, v.word FROM (SELECT DISTINCT phrase FROM q1 WHERE phrase NOT LIKE '% %') p JOIN vocab v ON starts_with(v.word, p.phrase)),
mp AS (SELECT DISTINCT phrase, len(string_split(phrase, ' ')) AS m FROM q1 WHERE phrase LIKE '% %'),
dl AS (SELECT doc_id AS chunk_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
mtf AS (SELECT phrase, chunk_id, count(*)::DOUBLE AS n
        FROM (SELECT phrase, m, chunk_id, ts, unnest(generate_series(1, len(ts) - m + 1)) AS i FROM mp, dl WHERE len(ts) >= m)
        WHERE starts_with(array_to_string(ts[i : i + m - 1], ' '), phrase) GROUP BY 1, 2),
ptf AS (SELECT pre.phrase, tf.chunk_id, sum(tf.n)::DOUBLE AS n FROM pre JOIN tf USING (word) GROUP BY 1, 2 UNION ALL SELECT * FROM mtf),
df AS (SELECT phrase, count(*) AS n_docs FROM ptf GROUP BY phrase),
need AS (SELECT query_id, count(*) AS k FROM q1 GROUP BY query_id),
hit AS (SELECT q1.query_id, ptf.chunk_id, count(*) AS k,
          sum(greatest(ln((st.n_rows - df.n_docs + 0.5::DOUBLE) / (df.n_docs + 0.5::DOUBLE)), 1e-6::DOUBLE) * ptf.n * 2.2::DOUBLE /
              (ptf.n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.dl / st.avg_len))) AS bm25
        FROM q1 JOIN ptf USING (phrase) JOIN df USING (phrase) JOIN len USING (chunk_id) CROSS JOIN st GROUP BY 1, 2),
ft AS (SELECT hit.query_id, hit.chunk_id, bm25, greatest(bm25 / (1 + bm25), 0.01::DOUBLE) AS score,
         row_number() OVER (PARTITION BY hit.query_id ORDER BY round(bm25, 9) DESC, hit.chunk_id) AS rank
       FROM hit JOIN need USING (query_id) WHERE hit.k = need.k)"""


def _fts(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25_topk(q, doc_corpus(spark, d).select("chunk_id", "text"))


@query("bm25_topk", f"WITH {FTS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ft WHERE rank <= 40")
def bm25_topk(spark, d):
    """Documents that hold every word of a benchmark text, by BM25."""
    return _fts(spark, d).select("query_id", "chunk_id", rounded("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_with_text", f"WITH {FTS} SELECT query_id, chunk_id, substring(text, 1, 200) AS text, source AS doc_hash FROM ft JOIN documents ON doc_id = chunk_id WHERE rank <= 40")
def bm25_with_text(spark, d):
    """Hits joined to their chunk, as a 200-character preview."""
    hits = _fts(spark, d).join(doc_corpus(spark, d).select("chunk_id", "text", F.col("source").alias("doc_hash")), "chunk_id")
    return hits.select("query_id", "chunk_id", F.substring("text", 1, 200).alias("text"), "doc_hash")


@query(
    "boolean_search",
    r"""WITH tok AS (SELECT p_partkey AS chunk_id, unnest(string_split(p_name, ' ')) AS w FROM part),
s AS (SELECT * FROM part)
SELECT a.k AS query_id, b.p_partkey AS chunk_id FROM (SELECT DISTINCT p_size % 2 AS k FROM part) a JOIN part b
  ON (a.k = 0 AND starts_with(split_part(b.p_name, ' ', 1), 'bl') AND NOT (split_part(b.p_name, ' ', 2) = 'bolt'))
  OR (a.k = 1 AND (starts_with(split_part(b.p_name, ' ', 2), 'gi')))""",
)
def boolean_search(spark, d):
    """AND-ed prefix terms with a negated term."""
    p = table(spark, d, "part")
    q = p.select((F.col("p_size") % 2).alias("query_id")).distinct().withColumn("query", F.when(F.col("query_id") == 0, "BL -bolt").otherwise("gi"))
    return R.bm25_topk(q, p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")), k=None).select("query_id", "chunk_id")


@query(
    "phrase_search",
    """WITH h AS (SELECT p_partkey AS chunk_id, len(string_split(p_name, ' ')) + 0.0::DOUBLE AS dl, starts_with(p_name, 'small ri') AS hit FROM part),
s AS (SELECT count(*) AS n, avg(dl) AS avg_len, count(*) FILTER (hit) AS df FROM h)
SELECT chunk_id, round(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)), 6) AS bm25
FROM h, s WHERE hit""",
)
def phrase_search(spark, d):
    """A term with a separator is a phrase whose last word may continue; it counts and scores as one term."""
    p = table(spark, d, "part")
    q = p.agg(F.min(F.lit(1)).alias("query_id")).withColumn("query", F.lit("small-ri"))
    hits = R.bm25_topk(q, p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")), k=None)
    return hits.select("chunk_id", rounded("bm25"))


@query(
    "scope_restricted_search",
    """SELECT 1 AS query_id, p_partkey AS chunk_id FROM part WHERE contains(' ' || p_name || ' ' || lower(p_type) || ' ', ' red') AND p_type IN ('ECONOMY', 'SMALL') AND p_size > 0""",
)
def scope_restricted_search(spark, d):
    """Search limited to OR-ed scope words; rows marked illegal are never returned."""
    p = table(spark, d, "part")
    q = p.agg(F.min(F.lit(1)).alias("query_id")).withColumn("query", F.lit("red"))
    corpus = p.select(
        F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"), F.array("p_type").alias("scope_path"),
        F.when(F.col("p_size") > 0, "active").otherwise("illegal").alias("status"),
    )
    return R.bm25_topk(q, corpus, k=None, scope_filter=["economy", "small"]).select("query_id", "chunk_id")


@query(
    "tokenize_documents",
    r"""SELECT doc_id, len(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS n_tokens,
  md5(array_to_string(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ')) AS digest FROM documents""",
)
def tokenize_documents(spark, d):
    t = TK.tokenize(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


# --- fusion ----------------------------------------------------------------------------------------------------

LISTS = f"""{SPARSE}, {FTS.replace('st AS (SELECT count', 'fst AS (SELECT count').replace('st.', 'fst.').replace('CROSS JOIN st', 'CROSS JOIN fst')},
ls AS (SELECT query_id, 0 AS list_id, chunk_id AS key, rank AS pos FROM st WHERE rank <= 40
       UNION ALL SELECT query_id, 1, chunk_id, rank FROM ft WHERE rank <= 40)"""


def _lists(spark, d):
    one = lambda df, i: df.select("query_id", F.lit(i).alias("list_id"), F.col("chunk_id").alias("key"), F.col("rank").alias("pos"))
    return one(_sparse_hits(spark, d), 0).unionByName(one(_fts(spark, d), 1))


@query("rrf_fusion", f"WITH {LISTS} SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + pos)), 9) AS score FROM ls GROUP BY 1, 2")
def rrf_fusion(spark, d):
    """Sparse and full-text lists fused by reciprocal rank."""
    return R.rrf(_lists(spark, d)).select("query_id", "key", rounded("score", 9))


@query(
    "rrf_duplicates",
    """WITH l AS (SELECT o_custkey AS query_id, o_orderpriority AS list_id, o_orderstatus AS key, o_orderkey AS pos FROM orders)
SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + p)), 9) AS score FROM (SELECT query_id, list_id, key, min(pos) AS p FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def rrf_duplicates(spark, d):
    """Five lists with repeated keys: the best position of a key counts once per list."""
    lists = table(spark, d, "orders").select(
        F.col("o_custkey").alias("query_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("list_id"), F.col("o_orderstatus").alias("key"),
        F.col("o_orderkey").alias("pos"),
    )
    return R.rrf(lists).select("query_id", "key", rounded("score", 9))


@query(
    "fusion_stats",
    f"""WITH {LISTS}, k AS (SELECT query_id, key, bool_or(list_id = 0) AS v, bool_or(list_id = 1) AS f FROM ls GROUP BY 1, 2)
SELECT query_id, count(*) FILTER (v AND NOT f) AS vector_hits, count(*) FILTER (f AND NOT v) AS fts_hits, count(*) FILTER (v AND f) AS both_hits FROM k GROUP BY 1""",
)
def fusion_stats(spark, d):
    return R.fusion_stats(_lists(spark, d))


@query(
    "union_first",
    f"WITH {LISTS} SELECT query_id, key AS chunk_id, min(list_id)::BIGINT AS list_id FROM ls GROUP BY 1, 2",
)
def union_first(spark, d):
    """Union of both lists with the first list's row preferred."""
    cols = ["query_id", "chunk_id", "rank"]
    u = R.union_first(_sparse_hits(spark, d).select(*cols), _fts(spark, d).select(*cols), ["query_id", "chunk_id"])
    return u.select("query_id", "chunk_id", F.col("list_id").cast("long").alias("list_id"))


RETRIEVE_SQL = f"""WITH {LISTS},
fu AS (SELECT query_id, key, sum(1.0::DOUBLE / (60 + pos)) AS score, min(list_id * 1000000000000 + pos) AS seen FROM ls GROUP BY 1, 2),
ex AS (SELECT fu.*, contains(d.text, trim(b.text)) AS exact, d.lang FROM fu JOIN documents d ON d.doc_id = fu.key JOIN benchmark b ON b.item_id = fu.query_id),
sc AS (SELECT query_id, bool_or(exact) AS short_circuit FROM ex GROUP BY 1),
m AS (SELECT ex.query_id, key, CASE WHEN short_circuit THEN 1.0::DOUBLE ELSE score END AS score, seen, short_circuit, lang
      FROM ex JOIN sc USING (query_id) WHERE NOT short_circuit OR exact),
s AS (SELECT *, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.8 WHEN 'fr' THEN 0.6 ELSE 0.4 END::DOUBLE AS scope_score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM m)
SELECT query_id, key AS chunk_id, short_circuit, round(score * (1 + scope_score), 9) AS final_score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + scope_score), 12) DESC, rank) AS final_rank FROM s"""


def _meta(spark, d):
    kind = F.when(F.col("lang") == "en", "national").when(F.col("lang") == "de", "industry").when(F.col("lang") == "fr", "enterprise").otherwise("project")
    return documents(spark, d).select(
        F.col("doc_id").alias("chunk_id"), "text", F.array(kind, "source").alias("scope_path"), F.lit(None).cast("string").alias("doc_type"),
        F.col("source").alias("doc_hash"), F.array().cast("array<map<string,string>>").alias("form_fields"),
        F.array().cast("array<struct<index:int,header:string>>").alias("column_headers"),
    )


def _queries(spark, d):
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("array<string>").alias("active_scope")
    )


@query("hybrid_retrieve", RETRIEVE_SQL)
def hybrid_retrieve(spark, d):
    """Fusion, short circuit on literal matches, and scope re-ranking."""
    hits, _ = R.retrieve(_queries(spark, d), _meta(spark, d), _sparse_hits(spark, d), _fts(spark, d))
    return hits.select("query_id", "chunk_id", "short_circuit", rounded("final_score", 9), F.col("final_rank").cast("long").alias("final_rank"))


@query("hybrid_retrieve_scoped", RETRIEVE_SQL.removesuffix("FROM s") + "FROM (SELECT * FROM s WHERE lang = 'en')")
def hybrid_retrieve_scoped(spark, d):
    """The same with an active scope, applied after fusion."""
    q = _queries(spark, d).withColumn("active_scope", F.array(F.lit("national")))
    hits, _ = R.retrieve(q, _meta(spark, d), _sparse_hits(spark, d), _fts(spark, d))
    return hits.select("query_id", "chunk_id", "short_circuit", rounded("final_score", 9), F.col("final_rank").cast("long").alias("final_rank"))


@query(
    "vector_only_retrieve",
    f"""WITH {SPARSE}, s AS (SELECT st.*, CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.8 WHEN 'fr' THEN 0.6 ELSE 0.4 END::DOUBLE AS sc FROM st JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 40)
SELECT query_id, chunk_id, round(score * (1 + sc), 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score * (1 + sc), 12) DESC, rank) AS final_rank FROM s""",
)
def vector_only_retrieve(spark, d):
    """Without full text: raw scores, no fusion."""
    hits, _ = R.retrieve(_queries(spark, d), _meta(spark, d), _sparse_hits(spark, d), None)
    return hits.select("query_id", "chunk_id", rounded("final_score"), F.col("final_rank").cast("long").alias("final_rank"))


@query(
    "exact_match",
    """SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, trim(b.text)) AND trim(b.text) <> ''""",
)
def exact_match(spark, d):
    """Documents that hold a benchmark text literally, wherever it begins."""
    return R.literal_matches(_queries(spark, d), doc_corpus(spark, d)).select("query_id", "chunk_id")


@query(
    "encode_once",
    """SELECT md5(k) AS cache_key, n FROM (SELECT sha256(text) || '|m1' AS k, count(*) AS n, min(lang) AS lang FROM documents GROUP BY 1) WHERE lang <> 'de'""",
)
def encode_once(spark, d):
    """Distinct texts still to encode, with how many rows each serves; German ones are stored."""
    docs = documents(spark, d)
    keyed = docs.select(ids.cache_key(F.col("text"), F.lit("m1")).alias("cache_key"), "lang")
    stored = keyed.groupBy("cache_key").agg(F.min("lang").alias("l")).where("l = 'de'")
    todo = R.missing_encodings(docs, stored, F.lit("m1"))
    counts = keyed.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))
    return todo.join(counts, "cache_key").select(F.md5("cache_key").alias("cache_key"), "n")


@query(
    "stale_encodings",
    """SELECT sum((epoch_us(ts) / 1e6::DOUBLE < (SELECT max(epoch_us(ts)) FROM events) / 1e6::DOUBLE - 86400)::INTEGER)::BIGINT AS stale, count(*) AS total FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)""",
)
def stale_encodings(spark, d):
    """Encodings past their time to live are computed again."""
    e = table(spark, d, "events")
    stamp = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    stored = e.groupBy("user_id").agg(F.max(stamp).alias("encoded_at")).select(
        F.concat(F.sha2(F.col("user_id").cast("string"), 256), F.lit("|m")).alias("cache_key"), "encoded_at"
    )
    now = e.agg(F.max(stamp)).scalar()
    users = e.select(F.col("user_id").cast("string").alias("text")).distinct()
    todo = R.missing_encodings(users, stored, F.lit("m"), now)
    return todo.agg(F.count(F.lit(1)).alias("stale")).withColumn("total", users.agg(F.count(F.lit(1))).scalar())


ANSWER_SQL = f"""WITH {PART_CHUNKS},
h AS (SELECT p_size AS query_id, chunk_id FROM ph),
i AS (SELECT p_size AS query_id, k, parameter, scope0,
   CASE k WHEN 1 THEN norm_value WHEN 3 THEN norm_value WHEN 5 THEN 0.1::DOUBLE END AS lower,
   CASE k WHEN 0 THEN norm_value WHEN 2 THEN norm_value WHEN 5 THEN (p_size + 10)::DOUBLE * 0.01::DOUBLE END AS upper, k <> 3 AS lower_inc, norm_unit FROM ph),
dd AS (SELECT DISTINCT query_id, parameter, lower, upper, norm_unit, k = 4 AS scalar FROM i),
r AS (SELECT query_id, parameter, max(lower) AS lo, min(upper) AS up, bool_and(lower_inc) AS inc FROM i WHERE k <> 4 GROUP BY 1, 2),
c AS (SELECT query_id, bool_or(coalesce(lo > up OR (lo = up AND NOT inc), false)) AS conflict FROM r GROUP BY 1)
SELECT q.query_id, n_chunks, n_constraints, CASE WHEN conflict THEN 'conflict' ELSE 'success' END AS gate, CASE WHEN conflict THEN 409 ELSE 200 END AS code, 'single' AS mode
FROM (SELECT query_id, count(*) AS n_chunks FROM h GROUP BY 1) q JOIN (SELECT query_id, count(*) AS n_constraints FROM dd GROUP BY 1) n USING (query_id) LEFT JOIN c USING (query_id)"""


@query("answer_queries", ANSWER_SQL)
def answer_queries(spark, d):
    """Gates, ranges and status for queries whose chunks are the parts of one size."""
    hits = part_chunks(spark, d).withColumns({"query_id": F.col("p_size"), "final_rank": F.col("chunk_id")})
    qs = hits.select("query_id").distinct().withColumns({"strict": F.lit(True), "active_scope": F.lit(None).cast("array<string>")})
    ready = hits.withColumn("scope_path", F.col("scope_path"))
    verdict, _, _ = A.answer(qs, ready)
    return verdict.select("query_id", "n_chunks", "n_constraints", "gate", "code", "mode")


_LISTS_SQL, _RANKED = RETRIEVE_SQL.removeprefix("WITH ").replace("ELSE 0.4 END", "WHEN 'reference' THEN 0.2 ELSE 0.4 END").rsplit("\nSELECT query_id, key", 1)
QUESTIONS_SQL = f"""WITH {PART_CHUNKS},
documents AS (SELECT chunk_id AS doc_id, CASE scope0 WHEN 'national' THEN 'en' WHEN 'industry' THEN 'de' WHEN 'enterprise' THEN 'fr' ELSE scope0 END AS lang, p_brand AS source,
  p_name || ': ' || CASE k WHEN 0 THEN 'length at most ' || p_size || ' mm' WHEN 1 THEN 'pressure at least ' || p_size || '.5 MPa' WHEN 2 THEN '温度不得超过' || p_size || '°C'
    WHEN 3 THEN '温度大于' || p_size || ' K' WHEN 4 THEN '掺量 is ' || p_size || '%' ELSE 'from 10 cm to ' || (p_size + 10) || ' cm' END AS text FROM ph),
benchmark AS (SELECT min(p_partkey) * 2 + e AS item_id, split_part(p_name, ' ', 1) || CASE e WHEN 0 THEN '' ELSE ' mm' END AS text FROM part, (SELECT unnest([0, 1]) AS e) GROUP BY split_part(p_name, ' ', 1), e),
{_LISTS_SQL},
rt AS (SELECT query_id, key{_RANKED}),
i AS (SELECT query_id, k, parameter, CASE k WHEN 1 THEN norm_value WHEN 3 THEN norm_value WHEN 5 THEN 0.1::DOUBLE END AS lower,
   CASE k WHEN 0 THEN norm_value WHEN 2 THEN norm_value WHEN 5 THEN (p_size + 10)::DOUBLE * 0.01::DOUBLE END AS upper, k <> 3 AS lower_inc, norm_unit FROM rt JOIN ph USING (chunk_id)),
dd AS (SELECT DISTINCT query_id, parameter, lower, upper, norm_unit, k = 4 AS scalar FROM i),
r AS (SELECT query_id, parameter, max(lower) AS lo, min(upper) AS up, bool_and(lower_inc) AS inc FROM i WHERE k <> 4 GROUP BY 1, 2),
c AS (SELECT query_id, bool_or(coalesce(lo > up OR (lo = up AND NOT inc), false)) AS conflict FROM r GROUP BY 1)
SELECT b.item_id AS query_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_constraints, 0) AS n_constraints, short_circuit,
  CASE WHEN n_chunks IS NULL THEN 'insufficient_recall' WHEN conflict THEN 'conflict' ELSE 'success' END AS gate, CASE WHEN n_chunks IS NULL THEN 404 WHEN conflict THEN 409 ELSE 200 END AS code
FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n_chunks, bool_or(short_circuit) AS short_circuit FROM rt GROUP BY 1) q ON q.query_id = b.item_id
LEFT JOIN (SELECT query_id, count(*) AS n_constraints FROM dd GROUP BY 1) n ON n.query_id = b.item_id LEFT JOIN c ON c.query_id = b.item_id"""


@query("question_constraints", QUESTIONS_SQL)
def question_constraints(spark, d):
    """From a question's text to its constraints in one plan: sparse and full-text search, fusion, short circuit,
    re-ranking, hints, gates, ranges and status."""
    word = F.split("p_name", " ")[0]
    first = table(spark, d, "part").groupBy(word.alias("word")).agg((F.min("p_partkey") * 2).alias("low"))
    ask = F.explode(F.array(F.struct(F.col("low").alias("query_id"), F.col("word").alias("query")), F.struct((F.col("low") + 1).alias("query_id"), F.concat("word", F.lit(" mm")).alias("query"))))
    q = first.select(ask.alias("q")).select("q.query_id", "q.query", F.lit(None).cast("array<string>").alias("active_scope"))
    chunks = part_chunks(spark, d).select(
        "chunk_id", "text", "scope_path", F.lit(None).cast("string").alias("doc_type"), "doc_hash", F.array().cast("array<map<string,string>>").alias("form_fields"),
        F.array().cast("array<struct<index:int,header:string>>").alias("column_headers"),
    )
    terms = _words(q.withColumn("text", F.col("query")), "query_id", "query_id").select("query_id", F.explode("terms").alias("term"))
    sparse = R.sparse_topk(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight")), _words(chunks, "chunk_id", "chunk_id"))
    hits, _ = R.retrieve(q, chunks, sparse, R.bm25_topk(q.select("query_id", "query"), chunks.select("chunk_id", "text")))
    hits = cut_lineage(hits)  # read by recall, hints and constraints
    verdict, _, _ = A.answer(q.select("query_id", "active_scope", F.lit(True).alias("strict")), hits)
    short = hits.groupBy("query_id").agg(F.bool_or("short_circuit").alias("short_circuit"))
    return verdict.join(short, "query_id", "left").select("query_id", "n_chunks", "n_constraints", "short_circuit", "gate", "code")


@query(
    "gate_ladder",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'insufficient_recall' WHEN o_orderkey % 5 = 0 THEN 'no_constraints_extracted'
  WHEN o_orderstatus = 'F' THEN 'strict_inferred' WHEN o_orderpriority = '1-URGENT' THEN 'conflict' ELSE 'success' END AS gate FROM orders""",
)
def gate_ladder(spark, d):
    """First failing gate, in order."""
    k = F.col("o_orderkey")
    gate = A.gates(k % 7, k % 5, F.lit(True), F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "1-URGENT", "CONFLICT").otherwise("OK"))
    return table(spark, d, "orders").select(k.alias("id"), gate.alias("gate"))

