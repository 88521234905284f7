"""Search over chunk tables: dense, sparse and full text, fusion, re-ranking.

Dense and sparse search are exact. Queries come in blocks of about QUERY_BLOCK rows; each
task scores its chunks against a block, a bounded number of scores at a time, and yields the
best k per query, so no (query, chunk) pair beyond those leaves the task. More queries than
one block mean more blocks, each a separate pass over the chunks.

Full-text search finds candidates through the rarest term of each query and checks the
other terms on the same row, so common words produce no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import scope as S
from ..functions import tokens as TK
from ..functions.ids import cache_key
from ..session import cut_lineage, fresh_path
from .scan import first_rows

QUERY_BLOCK = 4096
#: Scores, words and (word, query) pairs that a task holds at once.
CELLS = 1 << 21
IN_ROW_PHRASES = 20_000
#: Names of hit chunks that are sent to all tasks at most.
BROADCAST_NAMES = 100_000


# --- vectors ----------------------------------------------------------------------------


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(vector, lambda x: x / F.greatest(norm, F.lit(1e-9)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _unit_rows(vectors: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """Rows of length 1. Every vector must have the same number of dimensions, `size` if that is given."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    size = int(lengths[0]) if size is None and len(lengths) else size or 1
    if (lengths != size).any():
        raise ValueError(f"{int((lengths != size).sum())} vectors do not have {size} dimensions")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), size)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


class _Best:
    """The k best (score, id) of every query of a task, by score to 9 digits, then id: the same for any order or split
    of the rows. Memory is bounded by queries x k and one block of scores."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.kept: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, names: pa.Array, usable: np.ndarray | None = None) -> None:
        """scores: (queries, rows) of the named rows; usable marks the cells that count."""
        order = np.round(scores, 9)
        if usable is not None:
            order = np.where(usable, order, -np.inf)
        low = self.floor
        if order.shape[1] > self.k:
            low = np.maximum(low, np.partition(order, order.shape[1] - self.k, axis=1)[:, order.shape[1] - self.k])
        rows, cols = np.nonzero((order >= low[:, None]) & (order > -np.inf))
        self.kept.append(pa.table({"q": rows, "o": order[rows, cols], "s": scores[rows, cols], "id": names.take(pa.array(cols))}))
        self.size += len(rows)
        if self.size > 4 * self.k * len(self.floor) + CELLS:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.kept:
            return None
        rows = pa.concat_tables(self.kept)
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("o", "descending"), ("id", "ascending")]))
        q = rows.column("q").to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = q[nth == self.k - 1]
        self.floor[last] = rows.column("o").to_numpy()[nth == self.k - 1]
        rows = rows.filter(pa.array(nth < self.k))
        self.kept, self.size = [rows], len(rows)
        return rows


def _runs(sizes: np.ndarray, limit: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows whose sizes are `limit` together at most, and `rows` rows at most; a larger row is
    a run of its own."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right"))
        stop = max(begin + 1, stop if rows is None else min(stop, begin + rows))
        yield begin, stop
        begin = stop


def _query_blocks(queries: DataFrame, query_id: str, columns: list[str]) -> Iterator[pa.Table]:
    """The queries in blocks of about QUERY_BLOCK rows, by the hash of their id. They are computed once."""
    rows = cut_lineage(queries.select(query_id, *columns))
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)
        found = part.toArrow()
        if found.num_rows:
            yield found


def _ranked(hits: list[DataFrame], schema: str, chunks: DataFrame, query_id: str, chunk_id: str, k: int, score_threshold: float | None) -> DataFrame:
    if not hits:
        return chunks.sparkSession.createDataFrame([], schema).drop("_order").withColumn("rank", F.lit(0))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    if score_threshold is not None:
        every = every.where(F.col("score") >= score_threshold)
    return first_rows(every, [query_id], [F.col("_order").desc(), F.col(chunk_id)], k, "rank").drop("_order")


def _types(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"{query_id} {kind(queries, query_id)}, {chunk_id} {kind(chunks, chunk_id)}, score double, _order double"


def _emit(best: _Best, ids: pa.Array, query_id: str, chunk_id: str) -> Iterator[pa.RecordBatch]:
    rows = best.cut()
    if rows is not None:
        out = pa.table({query_id: ids.take(rows.column("q").combine_chunks()), chunk_id: rows.column("id"), "score": rows.column("s"), "_order": rows.column("o")})
        yield from out.to_batches(max_chunksize=10_000)


def dense_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = K.TOP_K,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "vector",
    score_threshold: float | None = None,
) -> DataFrame:
    """Exact cosine top-k: query_id, chunk_id, score, rank. Scores equal to 9 digits go by chunk_id.

    Each task yields k rows per query once, whatever the batches. Rows without a vector are left out; a vector of
    another size than the queries' is an error.
    """
    schema = _types(queries, chunks, query_id, chunk_id)
    chunk_rows = chunks.where(F.col(vector).isNotNull()).select(chunk_id, vector)
    hits = []
    for table in _query_blocks(queries.where(F.col(vector).isNotNull()), query_id, [vector]):
        packed = chunks.sparkSession.sparkContext.broadcast((table.column(query_id).combine_chunks(), _unit_rows(table.column(vector))))

        def best(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            ids, matrix = packed.value
            found, step = _Best(k, len(matrix)), max(1, CELLS // len(matrix))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    found.add(matrix @ _unit_rows(part.column(1), matrix.shape[1]).T, part.column(0))
            yield from _emit(found, ids, query_id, chunk_id)

        hits.append(chunk_rows.mapInArrow(best, schema))
    return _ranked(hits, schema, chunks, query_id, chunk_id, k, score_threshold)


def sparse_terms(weights: DataFrame, key: str, weight_map: str = "weights") -> DataFrame:
    """One row per (key, term, weight) from a term-weight map."""
    return weights.select(key, F.explode(weight_map).alias("term", "weight"))


def sparse_topk(
    query_terms: DataFrame, chunks: DataFrame, k: int = K.TOP_K, query_id: str = "query_id", chunk_id: str = "chunk_id",
    terms: str = "terms", weights: str | None = None,
) -> DataFrame:
    """Sparse dot product over shared terms: query_id, chunk_id, score, rank, for scores of shared terms only.

    query_terms: query_id, term, weight. chunks: a row for each chunk with its array of terms and, if named, their
    weights (else every occurrence weighs 1). Blocks of queries go to the tasks, which score whole chunks and yield k
    rows per query, so no (query, chunk) pair is shuffled; common terms make more sums in a task and no more rows.
    """
    schema = _types(query_terms, chunks, query_id, chunk_id)
    listed = query_terms.groupBy(query_id).agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("ts"))
    chunk_rows = chunks.select(chunk_id, terms, *([weights] if weights else []))
    hits = []
    for table in _query_blocks(listed.select(query_id, F.col("ts.term").alias("t"), F.col("ts.weight").alias("w")), query_id, ["t", "w"]):
        t = table.column("t").combine_chunks()
        owner = np.repeat(np.arange(table.num_rows), pc.list_value_length(t).to_numpy())
        code = pc.dictionary_encode(t.flatten())
        by_term = np.argsort(code.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(code.indices.to_numpy()[by_term], np.arange(len(code.dictionary) + 1))
        value = table.column("w").combine_chunks().flatten().to_numpy()[by_term]
        packed = chunks.sparkSession.sparkContext.broadcast((table.column(query_id).combine_chunks(), code.dictionary, starts, owner[by_term], value))

        def best(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            ids, known, starts, owner, value = packed.value
            found, step = _Best(k, len(ids)), max(1, CELLS // len(ids))
            for batch in batches:
                lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
                for at, stop in _runs(lengths, CELLS, step):
                    part = batch.slice(at, stop - at)
                    lists = part.column(1)
                    chunk = np.repeat(np.arange(len(lists)), lengths[at:stop])
                    place = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy()
                    weight = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float) if weights else np.ones(len(place))
                    # what a chunk has of a term is added up before it meets the queries
                    cell, own = np.unique(chunk[place >= 0] * len(known) + place[place >= 0], return_inverse=True)
                    weight = np.bincount(own, weights=weight[place >= 0], minlength=len(cell))
                    chunk, place = np.divmod(cell, max(1, len(known)))
                    count = starts[place + 1] - starts[place]
                    size = (len(ids), len(lists))
                    scores, shared = np.zeros(size[0] * size[1]), np.zeros(size[0] * size[1], bool)
                    for low, high in _runs(count, CELLS):
                        own = np.repeat(np.arange(low, high), count[low:high])
                        nth = np.arange(len(own)) + np.repeat(starts[place[low:high]] - np.cumsum(count[low:high]) + count[low:high], count[low:high])
                        cell = owner[nth] * len(lists) + chunk[own]
                        scores += np.bincount(cell, weights=value[nth] * weight[own], minlength=len(scores))
                        shared[cell] = True
                    found.add(scores.reshape(size), part.column(0), shared.reshape(size))
            yield from _emit(found, ids, query_id, chunk_id)

        hits.append(chunk_rows.mapInArrow(best, schema))
    return _ranked(hits, schema, chunks, query_id, chunk_id, k, None)


def sparse_weights(
    token_vectors: DataFrame, text_id: str, importance: Column, specials: list[int], bias: float = 0.0
) -> DataFrame:
    """Term weights of a text from its tokens: negative importance is 0, special and padding
    tokens are dropped, and the last occurrence of a term counts.

    token_vectors holds text_id, pos, term, is_padding and whatever `importance` reads.
    """
    rows = token_vectors.where(~F.col("is_padding") & ~F.col("term").isin(*specials)).withColumn(
        "weight", F.greatest(importance + F.lit(bias), F.lit(0.0))
    )
    return rows.groupBy(text_id, "term").agg(F.max_by("weight", "pos").alias("weight"))


# --- full text -----------------------------------------------------------------------------


def parse_queries(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, positives and negatives: ARRAY<ARRAY<STRING>> of phrases.

    Queries without a positive term are dropped: they match nothing.
    """
    terms = TK.search_terms(F.col(query))
    phrases = lambda negated: F.transform(
        F.filter(F.col("_t"), lambda t: t.negated == negated), lambda t: t.phrase
    )
    return (
        queries.withColumn("_t", terms)
        .select(query_id, phrases(False).alias("positives"), phrases(True).alias("negatives"))
        .where(F.size("positives") > 0)
    )


def _occurrences(columns: list[Column], phrase: Column, prefix: bool) -> Column:
    hits = [TK.phrase_hits(c, phrase, prefix) for c in columns]
    return sum(hits[1:], hits[0])


def _occurs(columns: list[Column], phrase: Column, prefix: bool) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | TK.phrase_occurs(column, phrase, prefix)
    return found


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def held_entries_udf(wanted):
    """Arrow UDF: which wanted entries ('=' a whole word, '^' a beginning) the words of a row hold."""

    @F.pandas_udf("array<string>")
    def held(words: pd.Series) -> pd.Series:
        entries = wanted.value
        whole = {e[1:] for e in entries if e[0] == "="}
        begins = {e[1:] for e in entries if e[0] == "^"}
        sizes = sorted({len(b) for b in begins})
        known: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            if word not in known:
                if len(known) > 200_000:
                    known.clear()
                hits = ["^" + word[:n] for n in sizes if n <= len(word) and word[:n] in begins]
                known[word] = ["=" + word, *hits] if word in whole else hits
            return known[word]

        return words.map(lambda ws: list({e for w in set(ws) for e in of(w)}))

    return held.asNondeterministic()


def bm25_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int | None = K.TOP_K,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    scope_filter: list[str] | None = None,
) -> DataFrame:
    """All positive terms as prefixes, no negative term, ranked by BM25; k = None gives all matches, without ranks.

    The corpus is read and cut into words once; the words are kept as a table in the shared folder, from which all
    statistics and candidates come.

    corpus: chunk_id, text, optional scope_path (searched as a second column) and status
    ('illegal' rows are never returned, but count for the statistics). The normalized score
    is |s| / (1 + |s|) with a floor.
    """
    scoped = "scope_path" in corpus.columns
    status = F.col("status") if "status" in corpus.columns else F.lit("active")
    rows = corpus.select(
        chunk_id,
        TK.tokenize(F.col("text")).alias("tokens"),
        (TK.tokenize(S.scope_text(F.col("scope_path"))) if scoped else F.array().cast("array<string>")).alias("scope_tokens"),
        status.alias("status"),
    )
    parsed = parse_queries(queries, query_id)

    def entry(phrase: Column) -> Column:
        """Lookup key of a phrase: its first word, which may continue if it is the only one."""
        return F.concat(F.when(F.size(phrase) == 1, F.lit("^")).otherwise(F.lit("=")), F.get(phrase, F.lit(0)))

    phrases = parsed.select(F.explode("positives").alias("phrase")).distinct().withColumn("entry", entry(F.col("phrase")))
    wanted_rows = phrases.select("entry").distinct().limit(IN_ROW_PHRASES + 1).toArrow().column(0).to_pylist()
    small = len(wanted_rows) <= IN_ROW_PHRASES
    if small:
        found = held_entries_udf(spark_broadcast(corpus, wanted_rows))(F.concat("tokens", "scope_tokens"))
        rows = rows.withColumn("entries", found)
    else:
        # every word of a row, and its beginnings in the lengths that single-word phrases have
        lengths = phrases.where(F.size("phrase") == 1).agg(F.sort_array(F.collect_set(F.length("entry") - 1)))
        words = F.array_distinct(F.concat("tokens", "scope_tokens"))
        rows = rows.withColumn("lengths", lengths.scalar()).withColumn(
            "entries",
            F.concat(
                F.transform(words, lambda t: F.concat(F.lit("="), t)),
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            words,
                            lambda t: F.transform(
                                F.filter("lengths", lambda n: n <= F.length(t)), lambda n: F.concat(F.lit("^"), F.left(t, n))
                            ),
                        )
                    )
                ),
            ),
        )
    place = fresh_path(corpus.sparkSession, "tokens")
    rows.withColumn("length", F.size("tokens") + F.size("scope_tokens")).write.parquet(place)
    rows = corpus.sparkSession.read.parquet(place)
    n_rows = rows.agg(F.count(F.lit(1))).scalar()
    avg_len = rows.agg(F.avg("length")).scalar()
    places = [F.col("tokens"), F.col("scope_tokens")] if scoped else [F.col("tokens")]

    def rows_with(wanted: DataFrame, columns: list[str]) -> DataFrame:
        """One row per corpus row and wanted entry it holds, with the named columns."""
        if small:
            # rows shrink to the entries they hold before they multiply
            kept = F.array_intersect("entries", wanted.agg(F.collect_set("entry")).scalar())
            return rows.select(*dict.fromkeys([*columns, "entries"]), F.explode_outer(kept).alias("entry")).where(
                F.col("entry").isNotNull()
            )
        keys = rows.select(chunk_id, F.explode_outer("entries").alias("entry")).join(wanted, "entry", "left_semi")
        needed = [c for c in dict.fromkeys([*columns, "entries"]) if c != chunk_id]
        return keys.join(rows.select(chunk_id, *needed), chunk_id) if needed else keys

    single = phrases.where(F.size("phrase") == 1)
    # document frequency of every phrase
    frequency = (
        rows_with(single, [chunk_id]).groupBy("entry").agg(F.count(F.lit(1)).alias("n_docs"))
        .join(single, "entry").select("phrase", "n_docs")
    )
    if not small or any(e.startswith("=") for e in wanted_rows):
        several = phrases.where(F.size("phrase") > 1)
        frequency = frequency.unionByName(
            rows_with(several, [chunk_id, "tokens", "scope_tokens"]).join(F.broadcast(several) if small else several.hint("merge"), "entry")
            .where(_occurs(places, F.col("phrase"), True))
            .groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"))
        )
    terms = parsed.select(query_id, F.posexplode("positives").alias("pos", "phrase")).join(frequency, "phrase", "left")
    ready = (
        terms.groupBy(query_id)
        .agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "pos", "phrase"))).alias("terms")
        )
        .where(F.get("terms", F.lit(0)).getField("n_docs") > 0)
        .join(parsed.select(query_id, "negatives"), query_id)
        .withColumns(
            {"n_rows": n_rows, "avg_len": avg_len, "entry": entry(F.get("terms", F.lit(0)).getField("phrase"))}
        )
    )
    # queries go to the rows, whose words are neither moved nor sent
    few = parsed.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK
    pairs = (
        rows_with(ready.select("entry").distinct(), [chunk_id, "tokens", "scope_tokens", "status"])
        .where(F.col("status") != "illegal")
        .join(F.broadcast(ready) if few else ready.hint("merge"), "entry")
    )
    # terms come rarest first, so most candidates fail on their first look-ups
    counted = pairs.where(F.forall("terms", lambda t: F.array_contains("entries", entry(t.phrase)))).where(
        F.forall("terms", lambda t: (F.size(t.phrase) == 1) | _occurs(places, t.phrase, True))
        & ~F.exists("negatives", lambda p: _occurs(places, p, False))
    )
    weight = lambda n_docs: F.greatest(
        F.log((F.col("n_rows") - n_docs + 0.5) / (n_docs + 0.5)), F.lit(K.BM25_MIN_IDF)
    )
    length = (F.size("tokens") + F.size("scope_tokens")).cast("double")
    part = lambda n_docs, n: weight(n_docs) * n * (K.BM25_K1 + 1) / (
        n + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * length / F.col("avg_len"))
    )
    raw = F.aggregate(F.transform("terms", lambda t: part(t.n_docs, _occurrences(places, t.phrase, True))), F.lit(0.0), lambda a, v: a + v)
    if scope_filter:
        # scope terms are OR-ed; each is a term of its own on the scope column and adds to the score
        found = F.lit(False)
        for i, word in enumerate(scope_filter):
            hits = TK.phrase_hits(F.col("scope_tokens"), TK.tokenize(F.lit(word)), False)
            n_docs = rows.agg(F.count_if(hits > 0)).scalar()
            counted = counted.withColumns({f"_n{i}": n_docs, f"_h{i}": hits})
            raw = raw + part(F.col(f"_n{i}"), F.col(f"_h{i}"))
            found = found | (F.col(f"_h{i}") > 0)
        counted = counted.where(found)
    scored = counted.select(query_id, chunk_id, raw.alias("bm25")).withColumn(
        "score", F.greatest(F.abs("bm25") / (1 + F.abs("bm25")), F.lit(K.BM25_FLOOR))
    )
    if k is None:
        return scored
    return first_rows(scored, [query_id], [F.round("bm25", 9).desc(), F.col(chunk_id)], k, "rank")


def literal_matches(queries: DataFrame, chunks: DataFrame, query_id: str = "query_id", query: str = "query", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """query_id, chunk_id of all chunks that hold the trimmed query literally, wherever in a word it begins.

    Blocks of queries go to the tasks, where one automaton of all of a block's queries reads each text once.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    bare = queries.select(query_id, F.btrim(F.col(query), F.lit(K.SPACES)).alias("bare")).where("bare <> ''")
    schema = f"{query_id} {kind(queries, query_id)}, {chunk_id} {kind(chunks, chunk_id)}"
    out: DataFrame | None = None
    for table in _query_blocks(bare, query_id, ["bare"]):
        packed = chunks.sparkSession.sparkContext.broadcast((table.column(query_id).to_pylist(), table.column("bare").to_pylist()))

        def find(batches: Iterator[pa.RecordBatch], packed=packed) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            names, wanted = packed.value
            owners: dict[str, list] = {}
            for name, word in zip(names, wanted):
                owners.setdefault(word, []).append(name)
            machine = ahocorasick.Automaton()
            for word in owners:
                machine.add_word(word, word)
            machine.make_automaton()
            for batch in batches:
                a, b = [], []
                for chunk, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for word in {w for _, w in machine.iter(content)} if content else ():
                        a += owners[word]
                        b += [chunk] * len(owners[word])
                yield pa.RecordBatch.from_arrays([pa.array(a, type=table_type), pa.array(b, type=batch.schema.field(0).type)], names=[query_id, chunk_id])

        table_type = table.column(query_id).type
        found = chunks.select(chunk_id, text).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return chunks.sparkSession.createDataFrame([], schema) if out is None else out


# --- fusion and ranking ------------------------------------------------------------------------


def rrf(lists: DataFrame, k: int = K.RRF_K, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """Reciprocal rank fusion of a long table query_id, list_id, key, pos (1 = best).

    The best position counts once per list. Order of first appearance settles ties.
    """
    if k < 1:
        return lists.select(query_id, key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    best = lists.groupBy(query_id, "list_id", key).agg(F.min("pos").alias("pos"))
    fused = best.groupBy(query_id, key).agg(
        F.sum(1.0 / (F.lit(k) + F.col("pos"))).alias("score"),
        F.min(F.col("list_id").cast("long") * F.lit(10**12) + F.col("pos")).alias("first_seen"),
    )
    return fused


def fusion_stats(lists: DataFrame, query_id: str = "query_id", key: str = "key") -> DataFrame:
    """Keys only in list 0, only in list 1, and in both, per query."""
    sides = lists.groupBy(query_id, key).agg(
        F.bool_or(F.col("list_id") == 0).alias("v"), F.bool_or(F.col("list_id") == 1).alias("f")
    )
    return sides.groupBy(query_id).agg(
        F.count_if(F.col("v") & ~F.col("f")).alias("vector_hits"),
        F.count_if(F.col("f") & ~F.col("v")).alias("fts_hits"),
        F.count_if(F.col("v") & F.col("f")).alias("both_hits"),
    )


def is_exact_match(query: Column, text: Column) -> Column:
    bare = F.btrim(query, F.lit(K.SPACES))
    return (bare != "") & F.coalesce(F.contains(text, bare), F.lit(False))


def hybrid_vector_topk(
    dense: DataFrame, sparse: DataFrame, k: int = K.TOP_K, query_id: str = "query_id", chunk_id: str = "chunk_id"
) -> DataFrame:
    """Dense and sparse candidates fused by reciprocal rank, as one vector list."""
    lists = dense.select(query_id, F.lit(0).alias("list_id"), F.col(chunk_id).alias("key"), F.col("rank").alias("pos")).unionByName(
        sparse.select(query_id, F.lit(1).alias("list_id"), F.col(chunk_id).alias("key"), F.col("rank").alias("pos"))
    )
    fused = rrf(lists, query_id=query_id)
    top = first_rows(fused, [query_id], [F.round("score", 12).desc(), F.col("first_seen")], k, "rank")
    return top.select(query_id, F.col("key").alias(chunk_id), "score", "rank")


def rerank(
    hits: DataFrame,
    boost: Column | bool = True,
    query_id: str = "query_id",
) -> DataFrame:
    """final = score * (1 + scope score), best first, earlier rank first among equals."""
    scope = S.scope_score(
        F.col("doc_type"), F.col("scope_path"), F.size("form_fields") > 0, F.size("column_headers") > 0, boost
    )
    scored = hits.withColumn("scope_score", scope).withColumn(
        "final_score", F.col("score") * (1 + F.col("scope_score"))
    )
    order = W.partitionBy(query_id).orderBy(F.round("final_score", 12).desc(), F.col("rank"))
    return scored.withColumn("final_rank", F.row_number().over(order))


def _chunks_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that are hit, stored. Names of hits go to the chunks, which are read once and neither moved nor sent; more
    than BROADCAST_NAMES of them are joined by a shuffle. `hits` is read twice."""
    names = hits.select("chunk_id").distinct()
    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    return cut_lineage(chunks.join(F.broadcast(names) if few else names.hint("merge"), "chunk_id", "left_semi"))


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    vector_hits: DataFrame,
    fts_hits: DataFrame | None,
    boost: bool = True,
    prefilter: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Hits with final ranks, and fusion statistics per query.

    queries: query_id, query, active_scope (nullable). vector_hits / fts_hits: query_id,
    chunk_id, score, rank. A query found literally in a retrieved chunk short-circuits to
    the chunks holding it, with score 1. Without fts_hits raw vector scores are used.
    prefilter applies the scope before the lists are fused instead of after.
    """
    columns = ["chunk_id", "text", "scope_path", "doc_type", "doc_hash", "form_fields", "column_headers"]
    meta = chunks.select(*columns)

    def keep_scope(df: DataFrame) -> DataFrame:
        joined = df.join(meta.select("chunk_id", "scope_path"), "chunk_id").join(queries.select("query_id", "active_scope"), "query_id")
        return joined.where(S.chunk_in_scope(F.col("scope_path"), F.col("active_scope"))).select(*df.columns)

    if prefilter:
        vector_hits = keep_scope(vector_hits)
        fts_hits = keep_scope(fts_hits) if fts_hits is not None else None
    if fts_hits is None:
        hits = cut_lineage(vector_hits.select("query_id", "chunk_id", "score", "rank"))
        meta = _chunks_of(hits, meta)
        merged = hits.withColumn("short_circuit", F.lit(False))
        stats = None
    else:
        lists = vector_hits.select("query_id", F.lit(0).alias("list_id"), F.col("chunk_id").alias("key"), F.col("rank").alias("pos")).unionByName(
            fts_hits.select("query_id", F.lit(1).alias("list_id"), F.col("chunk_id").alias("key"), F.col("rank").alias("pos"))
        )
        lists = cut_lineage(lists)
        meta = _chunks_of(lists.select(F.col("key").alias("chunk_id")), meta)
        fused = rrf(lists).withColumnRenamed("key", "chunk_id")
        per_query = W.partitionBy("query_id")  # at most two lists of hits
        matched = (
            fused.join(meta.select("chunk_id", "text"), "chunk_id")
            .join(queries.select("query_id", "query"), "query_id")
            .withColumn("exact", is_exact_match(F.col("query"), F.col("text")))
            .withColumns({"short_circuit": F.bool_or("exact").over(per_query), "n_exact": F.count_if("exact").over(per_query)})
        )
        any_exact = matched.groupBy("query_id").agg(F.first("short_circuit").alias("short_circuit"), F.first("n_exact").alias("n_exact"))
        flagged = matched.where(~F.col("short_circuit") | F.col("exact"))
        flagged = flagged.withColumn("score", F.when(F.col("short_circuit"), F.lit(1.0)).otherwise(F.col("score")))
        order = per_query.orderBy(F.round("score", 12).desc(), "first_seen")
        merged = flagged.select("query_id", "chunk_id", "score", F.row_number().over(order).alias("rank"), "short_circuit")
        plain = fusion_stats(lists)
        stats = plain.join(any_exact, "query_id", "left").select(
            "query_id",
            F.when(F.col("short_circuit"), F.col("n_exact")).otherwise(F.col("vector_hits")).alias("vector_hits"),
            F.when(F.col("short_circuit"), F.lit(0)).otherwise(F.col("fts_hits")).alias("fts_hits"),
            F.when(F.col("short_circuit"), F.lit(0)).otherwise(F.col("both_hits")).alias("both_hits"),
        )
    full = merged.join(meta, "chunk_id").join(queries.select("query_id", "active_scope"), "query_id")
    if not prefilter:
        full = full.where(S.chunk_in_scope(F.col("scope_path"), F.col("active_scope")))
    return rerank(full, boost), stats


def union_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two hit lists with one row per key, the first list's row preferred."""
    both = first.withColumn("list_id", F.lit(0)).unionByName(second.withColumn("list_id", F.lit(1)))
    return first_rows(both, keys, [F.col("list_id"), F.col("rank")])


# --- encodings -----------------------------------------------------------------------------------


def missing_encodings(
    texts: DataFrame, stored: DataFrame, model: Column, now: Column | None = None, ttl_seconds: int = K.ENCODING_TTL_SECONDS
) -> DataFrame:
    """Distinct texts with no stored vector, or only one older than the limit."""
    wanted = texts.select(cache_key(F.col("text"), model).alias("cache_key"), "text").dropDuplicates(["cache_key"])
    fresh = stored if now is None else stored.where(F.col("encoded_at") >= now - F.lit(ttl_seconds))
    return wanted.join(fresh.select("cache_key"), "cache_key", "left_anti")


def attach_encodings(texts: DataFrame, stored: DataFrame, model: Column) -> DataFrame:
    """Vectors back on every text row."""
    return texts.withColumn("cache_key", cache_key(F.col("text"), model)).join(
        stored.select("cache_key", "vector"), "cache_key", "left"
    )


def encode(texts: DataFrame, encoder) -> DataFrame:
    """Apply a plug-in Arrow encoder (pandas UDF text -> vector) to distinct texts."""
    return texts.withColumn("vector", encoder("text"))
