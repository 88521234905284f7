"""Ranked lexical search: MaxScore with the joint maxima of term pairs.

The index is a table of segments of at most SEGMENT_DOCS documents. A segment has, for every term, the documents that
hold it with their impacts, and the largest impact in every block of BLOCK documents; and for every chosen pair of terms
the list of the blocks in which documents hold both, each with the largest joint impact of such a document. A document
that holds both terms of a pair scores at most the joint maximum with them, one that holds one of them at most that term's
own maximum. So the larger of these three bounds what both add, and disjoint pairs, each with its bound, and the single
terms left bound a document's score: tighter than the sum of independent maxima.

A query keeps the k-th best score so far as its floor. In every segment, its terms are sorted by largest impact. Blocks
whose bound is below the floor are skipped. The first terms, as many as cannot reach the floor together, are not
essential: documents with no other term are never touched, and the others ask for these terms only while what they have
and the bound of the terms left reaches the floor. Scores are exact whole numbers, equal to the floor counts as reaching.

Documents are read once for each block of queries, whose terms are all that is indexed. Terms are named by a 64-bit hash
of their bytes and by their length. No posting is dealt by its term: segments are made where documents are read, so a
frequent term is spread over all tasks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_of, key_id, small_batches
from .query_blocks import Batches, Best, column, in_blocks, lists, passes, stored
from .words import blocks

SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK = 4096, 1 << 20, 64
BLOCKS = SEGMENT_DOCS // BLOCK
#: Different terms of the queries of one block of queries.
TERMS_AT_ONCE = 1 << 18

_COUNTED = "ids array<long>, sizes array<long>, terms array<int>, many array<int>, docs array<int>, tf array<int>"
_SEGMENT = (
    "ids array<long>, terms array<int>, many array<int>, docs array<int>, impacts array<long>,"
    " pairs array<int>, pair_many array<int>, pair_blocks array<int>, joint array<long>"
)


# --- terms ---------------------------------------------------------------------------------------


def _named(block) -> np.ndarray:
    """Names of the words of a block: their hashes, changed by their lengths."""
    return (block.hashes + (block.ends - block.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _item_terms(batches: Batches) -> Batches:
    """(id, text) to (id, different terms)."""
    for batch in batches:
        names = [np.zeros(0, np.int64)] * batch.num_rows
        for block in blocks(batch.column(1)):
            own = _named(block)
            for d, (at, n) in enumerate(zip(block.before.tolist(), block.n_words.tolist())):
                names[block.first + d] = np.unique(own[at : at + n])
        flat = np.concatenate(names) if names else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat, [len(n) for n in names])], names=["item", "terms"])


# --- the index -----------------------------------------------------------------------------------


def _counted(vocabulary: np.ndarray) -> Callable[[Batches], Batches]:
    """(id, text) to segments: ids and words of the documents with a word, and for each term of the vocabulary the
    documents that hold it, by their place in the segment, and how often."""

    def segment(ids: list, sizes: list, keys: list, tfs: list) -> pa.RecordBatch:
        key, tf = np.concatenate(keys), np.concatenate(tfs)
        order = np.argsort(key, kind="stable")  # by term, then document
        key, tf = key[order], tf[order]
        terms, many = np.unique(key // SEGMENT_DOCS, return_counts=True)
        cols = [np.concatenate(ids), np.concatenate(sizes), terms.astype(np.int32), many.astype(np.int32), (key % SEGMENT_DOCS).astype(np.int32), tf.astype(np.int32)]
        return pa.RecordBatch.from_arrays([lists(c, [len(c)]) for c in cols], names=["ids", "sizes", "terms", "many", "docs", "tf"])

    def run(batches: Batches) -> Batches:
        held, docs, postings = ([], [], [], []), 0, 0
        for batch in batches:
            names = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                own = _named(block)
                at = np.minimum(np.searchsorted(vocabulary, own), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == own if len(vocabulary) else np.zeros(len(own), bool)
                some = np.flatnonzero(block.n_words)
                place = np.zeros(len(block.n_words), np.int64)
                place[some] = np.arange(len(some))
                key, tf = np.unique(place[block.doc[known]] * max(len(vocabulary), 1) + at[known], return_counts=True)
                place, term = np.divmod(key, max(len(vocabulary), 1))
                begin = 0
                while begin < len(some):  # as many documents as the open segment has room for
                    end = min(len(some), begin + SEGMENT_DOCS - docs)
                    a, b = np.searchsorted(place, [begin, end])
                    for part, x in zip(held, (names[block.first + some[begin:end]], block.n_words[some[begin:end]], term[a:b] * SEGMENT_DOCS + place[a:b] - begin + docs, tf[a:b])):
                        part.append(x)
                    docs, postings, begin = docs + end - begin, postings + b - a, end
                    if docs == SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                        yield segment(*held)
                        held, docs, postings = ([], [], [], []), 0, 0
        if docs:
            yield segment(*held)

    return run


def impacts(tf: np.ndarray, sizes: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term adds to a document's score; whole numbers throughout."""
    m = 10 + (90 * sizes * n_docs) // n_words
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def chosen_pairs(items: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """(pairs, 2) of terms, the first the smaller number: each item's terms by weight, paired with the next and with the
    one after it, so that a choice is left when the bounds of a segment are known."""
    found = [np.zeros((0, 2), np.int64)]
    for terms in items:
        own = terms[np.lexsort((terms, weights[terms]))]
        for step in (1, 2):
            found.append(np.sort(np.stack([own[:-step], own[step:]], axis=1), axis=1) if len(own) > step else found[0])
    return np.unique(np.concatenate(found), axis=0)


def _scored(shared: dict) -> Callable[[Batches], Batches]:
    """Counted segments to segments with impacts and lists of pairs."""
    weights, pairs, n_docs, n_words = (shared[k] for k in ("weights", "pairs", "n_docs", "n_words"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, terms, many, docs, tf = (column(batch, c, row) for c in ("ids", "sizes", "terms", "many", "docs", "tf"))
                impact = impacts(tf.astype(np.int64), sizes[docs], np.repeat(weights[terms], many), n_docs, n_words)
                ends = np.cumsum(many)
                at = np.searchsorted(terms, pairs)
                at[at == len(terms)] = 0
                here = np.flatnonzero((terms[at] == pairs).all(axis=1)) if len(terms) else np.zeros(0, np.int64)
                lists_ = [np.zeros(0, np.int64)], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                one, last = np.zeros(SEGMENT_DOCS, np.int64), -1
                for p in here.tolist():
                    i, j = at[p]
                    if i != last:
                        one[:] = 0
                        one[docs[ends[i] - many[i] : ends[i]]] = impact[ends[i] - many[i] : ends[i]]
                        last = i
                    own = docs[ends[j] - many[j] : ends[j]]
                    with_one = one[own]
                    both = with_one > 0
                    own, joint = own[both] // BLOCK, (with_one + impact[ends[j] - many[j] : ends[j]])[both]
                    if len(own):
                        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        for part, x in zip(lists_, ([p], len(begin), own[begin], np.maximum.reduceat(joint, begin))):
                            part.append(x)
                cols = [
                    ids, terms, many, docs, impact, np.concatenate(lists_[0]).astype(np.int32), np.array(lists_[1][1:], np.int32),
                    np.concatenate(lists_[2]).astype(np.int32), np.concatenate(lists_[3]),
                ]
                yield pa.RecordBatch.from_arrays([lists(c, [len(c)]) for c in cols], names=["ids", "terms", "many", "docs", "impacts", "pairs", "pair_many", "pair_blocks", "joint"])

    return run


# --- the search ----------------------------------------------------------------------------------


class _Segment:
    def __init__(self, batch: pa.RecordBatch, row: int, n_pairs: int):
        self.ids, self.terms, many, self.docs, self.impacts = (column(batch, c, row) for c in ("ids", "terms", "many", "docs", "impacts"))
        self.begin = np.concatenate([[0], np.cumsum(many)])
        term = np.repeat(np.arange(len(many)), many)
        self.most = np.zeros((len(many), BLOCKS), np.int64)
        np.maximum.at(self.most, (term, self.docs // BLOCK), self.impacts)
        pairs, pair_many, at, joint = (column(batch, c, row) for c in ("pairs", "pair_many", "pair_blocks", "joint"))
        self.row = np.full(n_pairs, -1)
        self.row[pairs] = np.arange(len(pairs))
        self.joint = np.zeros((len(pairs) + 1, BLOCKS), np.int64)  # the last row is that of pairs without a common document
        self.joint[np.repeat(np.arange(len(pairs)), pair_many), at] = joint

    def of(self, i: int) -> slice:
        return slice(self.begin[i], self.begin[i + 1])


def pair_bounds(most: np.ndarray, joint: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the first 0, 1, .. terms together, of a whole segment, and of all terms in every block.

    most: (terms, blocks), in ascending order of the largest; joint: of pairs (later, earlier) their joint maxima by block.
    Each term joins the free earlier term with which it saves most, or stays alone."""
    top = most.max(axis=1)
    prefix, every, free = np.zeros(len(most) + 1, np.int64), np.zeros(most.shape[1], np.int64), set()
    for k in range(len(most)):
        adds, mate = top[k], -1
        for j in free:
            both = joint.get((k, j))
            if both is not None:
                more = max(int(both.max()), int(top[k]), int(top[j])) - top[j]
                if more < adds:
                    adds, mate = more, j
        prefix[k + 1] = prefix[k] + adds
        if mate < 0:
            free.add(k)
            every += most[k]
        else:
            free.discard(mate)
            every += np.maximum(np.maximum(joint[k, mate], most[k]), most[mate]) - most[mate]
    return prefix, every


def _search(block: dict, k: int) -> Callable[[Batches], Batches]:
    items, pairs = block["items"], block["pairs"]
    n_terms = block["n_terms"]
    code = pairs[:, 0] * n_terms + pairs[:, 1]

    def partners(terms: np.ndarray) -> list[tuple[int, int, int]]:
        """Places of two terms of an item, and their pair."""
        a, b = np.triu_indices(len(terms), 1)
        want = terms[a] * n_terms + terms[b]
        at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
        good = code[at] == want if len(code) else np.zeros(len(want), bool)
        return list(zip(a[good].tolist(), b[good].tolist(), at[good].tolist()))

    mates = [partners(t) for t in items]

    def one(seg: _Segment, terms: np.ndarray, own: list[tuple[int, int, int]], floor: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = np.searchsorted(seg.terms, terms)
        at[at == len(seg.terms)] = 0
        here = np.flatnonzero(seg.terms[at] == terms)
        if not len(here):
            return None
        most = seg.most[at[here]]
        order = np.argsort(most.max(axis=1), kind="stable")
        here, most = here[order], most[order]
        place = np.full(len(terms), -1)
        place[here] = np.arange(len(here))
        joint = {}
        for i, j, p in own:
            x, y = place[i], place[j]
            if x >= 0 and y >= 0:
                joint[max(x, y), min(x, y)] = seg.joint[seg.row[p]]
        prefix, every = pair_bounds(most, joint)
        alive = every >= floor
        if prefix[-1] < floor or not alive.any():
            return None
        essential = int(np.searchsorted(prefix, floor)) - 1  # the first terms, whose bound is below the floor
        score = np.zeros(len(seg.ids), np.int64)
        whole = alive.all()
        for i in range(max(essential, 0), len(here)):
            part = seg.of(at[here[i]])
            docs, impact = seg.docs[part], seg.impacts[part]
            if not whole:
                good = alive[docs // BLOCK]
                docs, impact = docs[good], impact[good]
            score[docs] += impact
        docs = np.flatnonzero(score)
        for i in range(essential - 1, -1, -1):
            docs = docs[score[docs] + prefix[i + 1] >= floor]
            if not len(docs):
                return None
            part = seg.of(at[here[i]])
            holds = seg.docs[part]
            where = np.minimum(np.searchsorted(holds, docs), len(holds) - 1)
            score[docs] += np.where(holds[where] == docs, seg.impacts[part][where], 0)
        docs = docs[score[docs] >= floor]
        if len(docs) > k:
            docs = docs[score[docs] >= np.partition(score[docs], -k)[-k]]
        return seg.ids[docs], score[docs]

    def run(batches: Batches) -> Batches:
        best = Best(k, len(items), 1, distinct=False)
        for batch in batches:
            for row in range(batch.num_rows):
                seg = _Segment(batch, row, len(pairs))
                for q, terms in enumerate(items):
                    found = one(seg, terms, mates[q], int(best.floor[q])) if len(seg.terms) else None
                    if found is not None:
                        best.add(np.full(len(found[0]), q), found[1], found[0])
                best.cut()
        q, s, i = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block["places"][q]), pa.array(i), pa.array(s)], names=["place", "id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item, rank, doc, score: the k documents of the highest score above 0 of every item, equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null and empty texts
    have none; such documents do not count, such items get no row. Every row of docs is a document of its own, so repeated
    rows all count and can all be ranked; a null id comes before all others. Items equal in id and text count once; of two
    texts with one id each gets its own ranks. Other columns have no effect. Empty tables give no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(key_id(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).distinct()
    kind = items.schema[item_col].dataType
    terms = asked.mapInArrow(_item_terms, "item long, terms array<long>").where(F.size("terms") > 0)
    terms = stored(terms.select(F.monotonically_increasing_id().alias("place"), "item", "terms", F.size("terms").alias("n")), "search-items")

    def blocks_of_items() -> Iterator[tuple[DataFrame, dict]]:
        for found in in_blocks(terms, TERMS_AT_ONCE, "n"):
            names = found["terms"].combine_chunks()
            names = names if isinstance(names, pa.Array) else pa.concat_arrays(names.chunks)
            flat, sizes = names.flatten().to_numpy(zero_copy_only=False), names.value_lengths().to_numpy()
            vocabulary = np.unique(flat)
            own = np.split(np.searchsorted(vocabulary, flat), np.cumsum(sizes)[:-1])
            counted = _with(spark, texts, vocabulary, _counted, _COUNTED, "search-counted")
            total = counted.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
            if not total["n"]:
                continue
            pairs_of = counted.select(F.explode(F.arrays_zip("terms", "many")).alias("t")).groupBy("t.terms").agg(F.sum("t.many").alias("df")).toPandas()
            df = np.zeros(len(vocabulary), np.int64)
            df[pairs_of["terms"].to_numpy()] = pairs_of["df"].to_numpy()
            weights = weights_of(df, total["n"])
            pairs = chosen_pairs(own, weights)
            shared = {"weights": weights, "pairs": pairs, "n_docs": total["n"], "n_words": total["words"]}
            index = _with(spark, counted, shared, _scored, _SEGMENT, "search-index")
            yield index, {"items": own, "places": found["place"].to_numpy(), "pairs": pairs, "n_terms": len(vocabulary)}

    hits = None
    for index, block in blocks_of_items():
        found = passes(index, iter([block]), lambda b: _search(b, k), "place long, id long, score long", "search-hits")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "place long, id long, score long")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    out = hits.join(terms.select("place", "item"), "place")
    return out.select(F.col("item").cast(kind).alias("item"), "rank", id_of("id").alias("doc"), "score")


def _with(spark, rows: DataFrame, value: object, task: Callable, schema: str, name: str) -> DataFrame:
    """passes() of one block, whose value is bounded."""
    return passes(rows, iter([value]), task, schema, name)
