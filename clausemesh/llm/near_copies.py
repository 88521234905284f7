"""Near copies by exact Jaccard similarity of word shingles, over a prefix join.

A document is the set of hashes of its shingles; equal texts are one set. All hashes have one order, rare ones first as
far as a sample tells. The prefix of a set of n hashes is its first n - ceil(t n) + 1. Sets of similarity t share hashes of
their prefixes: at least ceil(t / (1 + t) (n + n')) - max(ceil(t n), ceil(t n')) + 1 of them, as of the set whose prefix ends
first, no prefix hash can be found behind the other's prefix. Whatever the sample said, no pair of similarity t is missed.

Links begin with the trie of SimHash fingerprints (simhash.links) over the same shingles: sets whose fingerprints differ in few
bits are verified first, and joined. Fingerprints alone miss most pairs of similarity 0.8, which differ in about ten bits, so
all sets go through the prefix join, too, for what the trie did not link.

Rows (hash, size and place, set) are sorted by range, so a hash that very many sets have is cut over several tasks. Rows
whose hash no other set has are dropped there, and every other row gets a representative among the rows before it, if the two
fit in size and place. Groups of near copies are then joined without forming their pairs: each set is verified against its
likeliest representative, ROUNDS times over, and only hashes that sets of different components still share are looked at once
more, for pairs of sets of different components. Such a hash with more than GROUP_ROWS sets is dealt as pairs of parts of
it. The pairs that have enough hashes in common are sifted by sketches of their whole sets, which rule out no pair of the
similarity, and those left are verified on their whole texts; only texts of such pairs are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, give_back_memory, keyed, small_batches
from .query_blocks import stored
from .simhash import SEED, one_of_each

SHINGLE = 5
SIMILARITY = 0.8
#: One document in SAMPLE is counted for the order of hashes, by the last bits of the hash; the HEAVY largest counts matter.
SAMPLE, BITS, HEAVY = 8, 22, 1 << 18
PAIRS_AT_ONCE, ROWS_AT_ONCE = 1 << 18, 1 << 16
GROUP_ROWS = 50_000
BLOCK_SETS, PAIRS_TOGETHER = 2000, 5000
#: Times that each set is verified against its likeliest representative of another component.
ROUNDS = 3
BLOOM_BITS = 1 << 25
#: Bits of a sketch for each hash, at least.
SKETCH_BITS = 4
_HAS_WORDS = r"[^\x20\x09-\x0D]"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words (of all words, if they are fewer); empty without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[-max(1, len(words) - size + 1) :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64).view(np.int64))


def _need(share: float, n):
    """The least whole number that is `share` of n or more."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _weights(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of frequent hashes and a class for each, by a sample of the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, shingles(text, size) & ((1 << BITS) - 1), 1)
        found = np.flatnonzero(counts)
        for i in range(0, len(found), ROWS_AT_ONCE):
            part = found[i : i + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], names=["bucket", "n"])

    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(text_col)
    rows = sample.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 4")
    rows = rows.orderBy(F.desc("n"), "bucket").limit(HEAVY).toArrow()  # toPandas() makes a Python object of every row
    return rows["bucket"].to_numpy(), np.ceil(np.log2(rows["n"].to_numpy().astype(float))).astype(np.uint8)


def _sets(size: int, similarity: float, buckets: np.ndarray, classes: np.ndarray) -> Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]:
    """Size and prefix of the set of each text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight = np.zeros(1 << BITS, np.uint8)
        weight[buckets] = classes
        for batch in texts:
            rows = []
            for text in batch:
                own = shingles(text, size)
                n = len(own)
                order = np.argsort(weight[own & ((1 << BITS) - 1)], kind="stable")
                rows.append((n, own[order[: n - int(_need(similarity, n)) + 1]]))
            yield pd.DataFrame(rows, columns=["n", "first"])
        give_back_memory()

    return run


def _fit(similarity: float, n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Can sets of n and m hashes that share the ones at these places be alike? The hashes before may be shared, too."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    return (low >= _need(similarity, high)) & (np.minimum(n - at, m - to) + np.minimum(at, to) >= _need(similarity / (1 + similarity), n + m))


def _neighbours(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (h, nat, s) to those whose hash a neighbour has, too, with a representative (p): some set before it of the
    hash and the same class of sizes, by chance but always the same one, or for the first of a class the set before, if the
    two fit. Sets thus hang on others in a flat tree, not on a chain, and on another one for each hash that they share. The
    first and the last row of a task are kept, as their hash may go on in another task."""
    step = -np.log(similarity) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # h, nat, s, p, kept of the row before, which is not yet given

        def rows(h: np.ndarray, nat: np.ndarray, s: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(nat), pa.array(s), pa.array(p, mask=p == s)], names=["h", "nat", "s", "p"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, nat, s = (c.to_numpy() for c in batch.columns)
            if last is not None:
                h, nat, s = (np.append(x, y) for x, y in zip(last, (h, nat, s)))
            n, at = nat >> 32, nat & 0xFFFFFFFF
            same = h[1:] == h[:-1]
            size = np.floor(np.log(n) / step)
            begins = np.append(True, ~same | (size[1:] != size[:-1]))
            lead = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
            before = np.arange(len(h)) - lead
            chance = ((h ^ s).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            to = lead + (chance % np.maximum(before, 1).astype(np.uint64)).astype(np.int64)
            other = np.flatnonzero(begins[1:] & same) + 1  # first of a class, but not of the hash
            to[other] = other - 1
            to_nat, to_s = nat[to], s[to]
            p = np.where(_fit(similarity, n, at, to_nat >> 32, to_nat & 0xFFFFFFFF), to_s, s)  # a set before itself stands for none
            keep = np.append(same, False) | np.append(False, same)
            if last is not None:
                p[0], keep[0] = last[3], keep[0] | last[4]
            else:
                keep[0] = True
            last = (h[-1], nat[-1], s[-1], p[-1], bool(keep[-1]))
            keep[-1] = False
            if keep.any():
                yield rows(h[keep], nat[keep], s[keep], p[keep])
        if last is not None:
            yield rows(*[np.array([x]) for x in last[:4]])
        give_back_memory()

    return run


def _least(similarity: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many hashes of their prefixes sets of n and m hashes must share to be alike."""
    return _need(similarity / (1 + similarity), n + m) - np.maximum(_need(similarity, n), _need(similarity, m)) + 1


def _enough(similarity: float, group: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Rows whose set shares enough hashes (c) for some size of partner that its group has. What a partner asks for is
    least at the smallest or at the largest one that fits."""
    _, at = np.unique(group, return_inverse=True)
    small, large = np.full(at.max() + 1, 1 << 60), np.zeros(at.max() + 1, np.int64)
    np.minimum.at(small, at, n)
    np.maximum.at(large, at, n)
    low = np.maximum(small[at], _need(similarity, n))
    high = np.minimum(large[at], np.floor(n / similarity + 1e-9).astype(np.int64))
    return c >= np.minimum(_least(similarity, n, low), _least(similarity, n, high))


def _across(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b, their sizes) of sets of different components among rows (group, root, n, at, s, part, whole, c) that are
    sorted and hold all rows of a group. Unless the group is whole, only sets of different parts are compared. c is how
    many hashes a set shares with other components at all: sets that share too few are left out before pairs are made."""

    def of(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for _ in range(3):  # as sets go, sizes of partners go
            keep = _enough(similarity, columns[0], columns[2], columns[7])
            if keep.all():
                break
            columns = tuple(x[keep] for x in columns)
            if not len(columns[0]):
                return
        group, root, n, at, s, part, whole, c = columns
        new_group = np.append(True, group[1:] != group[:-1])
        new_run = new_group | np.append(True, root[1:] != root[:-1])
        run_of = np.cumsum(new_run) - 1
        runs_end = np.append(np.flatnonzero(new_group[new_run])[1:], run_of[-1] + 1)  # of each group, the run after its last
        later = runs_end[np.cumsum(new_group) - 1] - run_of - 1
        key = (run_of << 32) + n
        ends = np.cumsum(later)
        begin = 0
        while begin < len(n):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            many = later[begin:stop]
            row = np.repeat(np.arange(begin, stop), many)
            run = run_of[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            low = np.searchsorted(key, (run << 32) + _need(similarity, n[row]))
            high = np.searchsorted(key, (run << 32) + np.floor(n[row] / similarity + 1e-9).astype(np.int64), side="right")
            yield from pairs(row, low, np.maximum(high - low, 0), n, at, s, part, whole, c)
            begin = stop

    def pairs(row, low, many, n, at, s, part, whole, c) -> Iterator[pa.RecordBatch]:
        ends, begin = np.cumsum(many), 0
        while begin < len(row):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, side="right")))
            count = many[begin:stop]
            i = np.repeat(row[begin:stop], count)
            j = np.repeat(low[begin:stop] - np.cumsum(count) + count, count) + np.arange(count.sum())
            good = _fit(similarity, n[i], at[i], n[j], at[j]) & (whole[i] | (part[i] != part[j])) & (np.minimum(c[i], c[j]) >= _least(similarity, n[i], n[j]))
            if good.any():
                i, j = i[good], j[good]
                i, j = np.where(s[i] < s[j], i, j), np.where(s[i] < s[j], j, i)
                yield pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[j]), pa.array(n[i]), pa.array(n[j])], names=["a", "b", "n", "m"])
            begin = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows < ROWS_AT_ONCE or held[0][0][0] == held[-1][0][-1]:
                continue
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            yield from of(*[c[:cut] for c in whole])
            held, rows = [[c[cut:] for c in whole]], len(whole[0]) - cut
        if rows:
            yield from of(*[np.concatenate(c) for c in zip(*held)])
        give_back_memory()

    return run


def _maybe(names: DataFrame) -> Callable[[pd.Series], pd.Series]:
    """A Bloom filter of the numbers `s`, of BLOOM_BITS bits whatever their count, as a pandas UDF: true for all of them and
    for few or, when the filter is full, many others."""
    bit = lambda shift: F.shiftrightunsigned("s", shift).bitwiseAND(F.lit(BLOOM_BITS - 1))
    bits = names.select(F.explode(F.array(bit(0), bit(32))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("bits")).toArrow()
    table = np.zeros(BLOOM_BITS // 32, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)

    @F.pandas_udf("boolean")
    def maybe(s: pd.Series) -> pd.Series:
        h = s.to_numpy(np.int64).view(np.uint64)
        out = np.ones(len(h), bool)
        for shift in (0, 32):
            at = ((h >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
            out &= (table[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
        return pd.Series(out)

    return maybe


def _only(texts: DataFrame, names: DataFrame) -> DataFrame:
    """One text of each name (s), stored. Other texts are left where they are, but for the few that the filter lets pass."""
    return stored(texts.where(_maybe(names)("s")).dropDuplicates(["s"]).join(names, "s", "left_semi"), "near-texts")


def _sketch(own: np.ndarray) -> bytes:
    """A bit for each hash of a set, in a power of two of bits, at least SKETCH_BITS for each hash."""
    bits = np.zeros(1 << max(6, (SKETCH_BITS * len(own) - 1).bit_length()), bool)
    bits[own & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _most_shared(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
    """The most hashes that two sets of n and m hashes can share by their sketches (bytes): a bit that the other set lacks
    stands for at least one hash that it lacks. The larger sketch is laid over itself until it has the size of the smaller."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, size), axis=0) if len(z) > size else z for z in (x, y))
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _by_blocks(pairs: DataFrame, sets: DataFrame, verify: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], block_sets: int, together: int) -> DataFrame:
    """The pairs (a, b; stored) that verify() marks among pairs and their sets (s, ...).

    Both ends fall into blocks by their hash, and pairs of the same two blocks are verified together, so that a set in very
    many pairs is sent to as many groups as there are blocks, not to each pair. A group has about `together` pairs, or
    all of two blocks of about `block_sets` sets."""
    n_pairs, n_sets = max(1, pairs.count()), max(1, sets.count())
    block = lambda x: F.pmod(F.xxhash64(F.col(x)), F.lit(-(-n_sets // block_sets)))
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64(block("a"), block("b")), F.lit(-(-n_pairs // together))))
    sent = pairs.select(F.col("g").alias("to"), F.explode(F.array("a", "b")).alias("s")).distinct().join(sets, "s")

    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        good = verify(pairs, sets)
        give_back_memory()
        return pairs.loc[good, ["a", "b"]]

    return pairs.groupBy("g").cogroup(sent.groupBy("to")).applyInPandas(run, "a long, b long")


def _alike(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity: sifted by sketches (s, n, sketch), then verified on the texts."""

    def enough(both: int, n: int, m: int) -> bool:
        return both >= similarity * (n + m - both) - 1e-9

    def may(pairs: pd.DataFrame, sets: pd.DataFrame) -> np.ndarray:
        own = {s: (n, np.frombuffer(k, np.uint8)) for s, n, k in zip(sets["s"], sets["n"], sets["sketch"])}
        return np.array([enough(_most_shared(*own[a], *own[b]), own[a][0], own[b][0]) for a, b in zip(pairs["a"], pairs["b"])], bool)

    def are(pairs: pd.DataFrame, sets: pd.DataFrame) -> np.ndarray:
        own = {s: shingles(t, size) for s, t in zip(sets["s"], sets["text"])}
        shared = lambda a, b: len(np.intersect1d(own[a], own[b], assume_unique=True))
        return np.array([enough(shared(a, b), len(own[a]), len(own[b])) for a, b in zip(pairs["a"], pairs["b"])], bool)

    pairs = stored(pairs.select("a", "b"), "near-pairs")
    left = stored(_by_blocks(pairs, sketches, may, 4 * BLOCK_SETS, 4 * PAIRS_TOGETHER), "near-sifted")
    if not left.limit(1).count():
        return left
    asked = stored(left.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "near-asked")
    return _by_blocks(left, _only(texts, asked), are, BLOCK_SETS, PAIRS_TOGETHER)


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs with the roots of both ends."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rows.withColumns({f"{x}_root": F.coalesce(f"{x}_root", x) for x in ("a", "b")})


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links: components are found among the roots that the links join, not anew."""
    edges = _rooted(links, roots).where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    edges = stored(edges.distinct(), "near-edges")
    if not edges.limit(1).count():
        return roots
    above = components(edges)
    nodes = roots.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node")))
    above = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(nodes.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near-roots")


def _cross_pairs(shared: DataFrame, roots: DataFrame, similarity: float, group_rows: int) -> DataFrame:
    """a, b: pairs of sets of different components that have enough hashes of their prefixes in common."""
    rows = shared.join(roots, shared.s == roots.node, "left").select("h", "nat", "s", F.coalesce("root", "s").alias("root"))
    mixed = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    parts = F.ceil(F.col("n") / group_rows)
    rows = stored(rows.join(mixed.select(F.col("h"), parts.alias("parts")), "h"), "near-mixed")
    rows = rows.join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("c")), "s").withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select(
        F.xxhash64("h", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "root", F.shiftright("nat", 32).alias("n"),
        F.col("nat").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "s", "part", (F.col("part") == F.col("other")).alias("whole"), "c",
    )
    # in a group of two different parts no row is whole; groups of one hash value by chance would only give more candidates
    rows = rows.repartition("g").sortWithinPartitions("g", "root", "n", "s")
    pairs = rows.mapInArrow(_across(similarity), "a long, b long, n long, m long").groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("hits"))
    need = lambda share, n: F.ceil(F.lit(share) * n - 1e-9)
    least = need(similarity / (1 + similarity), F.col("n") + F.col("m")) - F.greatest(need(similarity, F.col("n")), need(similarity, F.col("m"))) + 1
    return pairs.where(F.col("hits") >= least).select("a", "b")


def _drawn(texts: DataFrame, size: int) -> DataFrame:
    """s, fp, n, sketch: the fingerprint of each text, and the size and the sketch of its set."""

    @F.pandas_udf("fp long, n long, sketch binary")
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([simhash.fingerprint_of(t, size) for t in batch], np.uint64).view(np.int64)
            sets = [shingles(t, size) for t in batch]
            yield pd.DataFrame({"fp": fps, "n": [len(x) for x in sets], "sketch": [_sketch(x) for x in sets]})

    return stored(texts.select("s", draw("text").alias("v")).select("s", "v.*"), "near-fingerprints")


def _trie_pairs(own: DataFrame, budget: int) -> DataFrame:
    """a, b: pairs of sets (s, fp) that the trie of fingerprints brings together. Sets of one fingerprint hang on the least of
    them, and that hangs on the one of the fingerprint it is linked to, so there is at most a pair or two for each set."""
    heads = stored(own.groupBy("fp").agg(F.min("s").alias("head")), "near-heads")
    same = own.join(heads, "fp").select(F.col("head").alias("a"), F.col("s").alias("b"))
    head = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    near = simhash.links(heads, budget).toDF("fa", "fb").join(head("fa", "a"), "fa").join(head("fb", "b"), "fb").select("a", "b")
    return same.unionByName(near).where("a <> b")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS,
    budget: int = simhash.BUDGET,
) -> DataFrame:
    """k_id, k_h, root for every row: rows have one root if a chain of documents leads from one to the other, each of which
    shares `similarity` or more of its shingles with the next (intersection by union).

    Words are cut at ASCII white space and A-Z lower-cased; a text of fewer words is one shingle. Null, empty and blank texts
    have no words and are alike. Texts of any length count whole. Repeated rows and equal texts are one document; null ids
    take part. Other columns have no effect. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    make = F.pandas_udf(_sets(shingle, similarity, *_weights(docs, text_col, shingle)), "n long, first array<long>")
    own = keyed(docs, id_col, text_col)
    texts = own.where(F.col("text").rlike(_HAS_WORDS)).select(F.col("k_h").alias("s"), "text")
    sets = texts.select("s", make("text").alias("v")).groupBy("s").agg(F.first("v.n").alias("n"), F.first("v.first").alias("first"))
    rows = sets.select("s", "n", F.posexplode("first").alias("at", "h")).select("h", (F.shiftleft("n", 32) + F.col("at")).alias("nat"), "s")
    rows = rows.repartitionByRange("h", "nat", "s").sortWithinPartitions("h", "nat", "s")
    shared = stored(rows.mapInArrow(_neighbours(similarity), "h long, nat long, s long, p long"), "near-rows")

    named = stored(shared.select("s").distinct(), "near-names")
    texts = _only(texts, named)
    drawn = _drawn(texts, shingle)
    sketches = drawn.select("s", "n", "sketch")
    alike = lambda pairs: _alike(pairs, sketches, texts, similarity, shingle)
    before = stored(shared.where("p is not null").groupBy(F.col("p").alias("a"), F.col("s").alias("b")).agg(F.count(F.lit(1)).alias("hits")), "near-before")
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = _joined(roots, alike(_trie_pairs(drawn.select("s", "fp"), budget)))
    for _ in range(ROUNDS):
        known = roots
        open_ = _rooted(before, roots).where("a_root <> b_root")
        likeliest = open_.groupBy("b").agg(F.max_by("a", F.struct("hits", "a")).alias("a"))
        roots = _joined(roots, alike(likeliest))
        if roots is known:  # nothing new was linked
            break
    roots = _joined(roots, alike(_cross_pairs(shared, roots, similarity, group_rows)))
    rows = own.select("k_id", "k_h", F.coalesce(F.col("text").rlike(_HAS_WORDS), F.lit(False)).alias("words"))
    alone = F.when(F.col("words"), F.col("k_h")).otherwise(F.lit(0).cast("long"))
    return rows.join(roots, rows.k_h == roots.node, "left").select("k_id", "k_h", F.coalesce("root", alone).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each group of similar ones; which one, see simhash.one_of_each()."""
    return one_of_each(docs, similar_groups(docs, id_col, text_col, shingle, similarity), id_col, text_col)
