"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive k-grams the one with the smallest hash is kept as a fingerprint (the rightmost of equals).
WINDOW + K - 1 = 10, so two texts that share 10 consecutive words share a fingerprint at the same place in both: the
search is complete. Fingerprints of documents and benchmark items are joined on their hash, and every hit is extended
word by word to both sides; the words themselves are compared, so hash collisions have no effect. The words within
SPAN - K of a fingerprint decide every window of 10 that holds it, so a fingerprint carries just these along.

An item of fewer than 10 words is one window, found among the documents' runs of that many words in the same join.

Documents are read once, inside Arrow batches. A Bloom filter of the items' hashes, whose size is fixed and does not
depend on either table, keeps the other fingerprints from the shuffle; when it fills up, more rows are shuffled and
results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_of, keyed, small_batches
from .words import Block, blocks, grams

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
BLOOM_BITS = 1 << 23

_CANDIDATES = pa.list_(
    pa.struct([("n", pa.int32()), ("h", pa.int64()), ("pos", pa.int32()), ("off", pa.int32()), ("words", pa.list_(pa.string()))])
)
_SCHEMA = "k_id long, k_h long, n_words long, found array<struct<n:int,h:long,pos:int,off:int,words:array<string>>>"


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BLOOM_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def _maybe(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _bits(h)
    return ((bloom[a >> 3] >> (a & 7)) & (bloom[b >> 3] >> (b & 7)) & 1).astype(bool)


def winnowed(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Positions (within the block's words) and hashes of the fingerprints of every document of SPAN words or more."""
    h = grams(block.hashes, K)
    size = len(h) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, np.int64), h[:0]
    low, at = h[:size].copy(), np.zeros(size, np.int8)
    for j in range(1, WINDOW):
        here = h[j : j + size]
        at[here <= low] = j
        np.minimum(low, here, out=low)
    whole = block.doc[:size] == block.doc[SPAN - 1 :]
    chosen = np.zeros(len(h), dtype=bool)
    chosen[(np.arange(size) + at)[whole]] = True
    pos = np.flatnonzero(chosen)
    return pos, h[pos]


def _short(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    h = grams(block.hashes, n)
    pos = np.flatnonzero(block.doc[: len(h)] == block.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return pos, h[pos]


def _scan(lengths: list[int], bloom: np.ndarray | None, items: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its number of words and candidates (n, hash, position, words around). n = 0 marks a fingerprint, else a
    run of n words. Of items, a short one has only the run that is the whole of it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            n_words, found = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
            for block in blocks(column):
                n_words[block.first : block.first + len(block.n_words)] = block.n_words
                for n in [0, *lengths]:
                    pos, h = _short(block, n) if n else winnowed(block)
                    if items and n:
                        keep = block.n_words[block.doc[pos]] == n
                        pos, h = pos[keep], h[keep]
                    if bloom is not None:
                        keep = _maybe(bloom, h)
                        pos, h = pos[keep], h[keep]
                    for i, g in zip(pos.tolist(), h.view(np.int64).tolist()):
                        d = int(block.doc[i])
                        first, size = int(block.before[d]), int(block.n_words[d])
                        lo, hi = (i, i + n) if n else (max(first, i - SPAN + K), min(first + size, i + SPAN))
                        found[block.first + d].append(
                            {"n": n, "h": g, "pos": i - first, "off": i - lo, "words": [block.word(x) for x in range(lo, hi)]}
                        )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words), pa.array(found, type=_CANDIDATES)], names=["k_id", "k_h", "n_words", "found"]
            )

    return scan


def _bloom(hits: DataFrame) -> np.ndarray:
    """The items' hashes as BLOOM_BITS bits; what reaches the driver is bounded by that."""
    bit = lambda shift: F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(BLOOM_BITS - 1))
    bits = hits.select(F.explode(F.array(bit(0), bit(32))).alias("bit"))
    byte = bits.groupBy(F.expr("bit div 8").cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 as int)))").alias("value"))
    got = byte.toArrow()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    out[got["at"].to_numpy()] = got["value"].to_numpy().astype(np.uint8)
    return out


def _run(mine, theirs):
    """How many words from the start of both arrays are equal."""
    same = F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: k_id, k_h, n_words of every row. spans: k_id, k_h, item, first, last (exclusive):
    maximal runs of shared words around each fingerprint, and occurrences of short items.

    A null or empty text has no words. A null item_id makes hits but is no item of the list. Equal rows have equal
    results. Empty tables give no spans. Only the named columns are read.
    """
    small_batches(docs.sparkSession)
    own = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("item_text"))
    own = own.select(F.monotonically_increasing_id().alias("k_id"), F.lit(0).cast("long").alias("k_h"), F.col("item_text").alias("text"), "item")
    own = cut_lineage(own)  # the row numbers have to stay
    text_of = own.select("k_id", "k_h", "text")
    of_items = text_of.mapInArrow(_scan(list(range(1, SPAN)), None, True), _SCHEMA)
    of_items = of_items.join(own.select("k_id", "item"), "k_id").select("item", F.explode("found").alias("f"))
    of_items = cut_lineage(of_items.select("item", "f.n", "f.h", "f.off", "f.words"))
    lengths = [r.n for r in of_items.select("n").distinct().where("n > 0").collect()]
    scanned = keyed(docs, doc_id, text).mapInArrow(_scan(sorted(lengths), _bloom(of_items), False), _SCHEMA)
    scanned = cut_lineage(scanned)
    mine = scanned.select("k_id", "k_h", F.explode("found").alias("f")).select(
        "k_id", "k_h", "f.n", "f.h", "f.pos", F.col("f.off").alias("d_off"), F.col("f.words").alias("d_words")
    )
    both = mine.join(of_items.distinct(), ["n", "h"])
    left = _run(F.reverse(F.slice("d_words", F.lit(1), F.col("d_off"))), F.reverse(F.slice("words", F.lit(1), F.col("off"))))
    right = _run(F.slice("d_words", F.col("d_off") + 1, F.lit(2 * SPAN)), F.slice("words", F.col("off") + 1, F.lit(2 * SPAN)))
    both = both.select("k_id", "k_h", "item", "n", "pos", F.size("d_words").alias("size"), (F.col("d_words") == F.col("words")).alias("same"),
                       left.alias("l"), right.alias("r"))
    long = (F.col("n") == 0) & (F.col("r") >= K) & (F.col("l") + F.col("r") >= SPAN)
    spans = both.where(long | ((F.col("n") > 0) & F.col("same"))).select(
        "k_id", "k_h", "item", (F.col("pos") - F.when(F.col("n") == 0, F.col("l")).otherwise(0)).alias("first"),
        (F.col("pos") + F.when(F.col("n") == 0, F.col("r")).otherwise(F.col("n"))).alias("last"),
    )
    return scanned.select("k_id", "k_h", "n_words"), spans


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for every document: k_id, k_h, n_words, n_hit (words in a shared span), items (sorted ids)."""
    documents, spans = hits(docs, items, doc_id, text, item_id, item_text)
    ends = spans.select("k_id", "k_h", "first", "last").distinct().groupBy("k_id", "k_h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a.upto))).alias("n"), F.greatest(a.upto, s["last"]).alias("upto")),
    )
    ends = ends.select("k_id", "k_h", covered["n"].cast("long").alias("n_hit"))
    names = spans.where("item is not null").select("k_id", "k_h", "item").distinct().groupBy("k_id", "k_h").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = documents.join(ends, ["k_id", "k_h"], "left").join(names, ["k_id", "k_h"], "left")
    return out.select("k_id", "k_h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
