"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

A fingerprint has 64 bits; a bit is set when it is set in more than half of the XXH64 hashes of the document's word
shingles. Distinct fingerprints form a binary trie. Pairs of trie nodes of one depth are followed downwards together,
with the number of bits in which their paths differ; a pair is dropped when that exceeds the error budget. Pairs that
end in two fingerprints are links.

The upper levels are walked on Spark: a table of node pairs is expanded, BITS levels at a time, wherever the two nodes
together hold more than NODE_ROWS fingerprints. The pairs left hold few fingerprints each, and each is walked to the
bottom in one task with numpy, in blocks of bounded size. Work is by distinct fingerprint, so a group of exact copies is
one leaf; inside a task, links are merged at once, and node pairs that lie in one component already are dropped, so a
dense group of near copies is not expanded into all its pairs. What a task returns is one link for each fingerprint
that hangs on another one of its two nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage
from .common import components, id_of, key_id, keyed, small_batches, unused

BUDGET = 4
SHINGLE = 4
SEED = 42
#: Depth at which the walk begins (a smaller trie is one task), and the levels of each further step.
FIRST_BITS, BITS = 4, 2
SMALL_ROWS, NODE_ROWS = 1 << 12, 1 << 17
BLOCK = 1 << 17
#: Nodes with so few pairs of fingerprints between them are leaves: the rest of the bits is compared at once.
LEAF_PAIRS = 32


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):
        part = np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += part.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(t) for t in batch], dtype="uint64").astype("int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_h, fp (64 bits as a long) for every row."""
    small_batches(docs.sparkSession)
    return keyed(docs, id_col, text_col).select("k_id", "k_h", _fingerprints("text").alias("fp"))


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- one pair of nodes, in a task ----------------------------------------------------------------


class _Groups:
    """Components of the fingerprints of a task, with a running count of label changes in sorted order, which tells at
    once whether a node lies in one component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        if not (a != b).any():
            return
        while (a != b).any():
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while True:
                nearer = self.label[self.label]
                if (nearer == self.label).all():
                    break
                self.label = nearer
            a, b = self.label[low], self.label[high]
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def joined(self, p: np.ndarray) -> np.ndarray:
        """Node pairs that lie in one component."""
        c = self.changes
        return (c[p[1] - 1] == c[p[0]]) & (c[p[3] - 1] == c[p[2]]) & (self.label[p[0]] == self.label[p[2]])


def _leaves(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of fingerprints below each of these small pairs of nodes."""
    wide = p[3] - p[2]
    count = (p[1] - p[0]) * wide
    own = np.repeat(np.arange(p.shape[1]), count)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    down, right = np.divmod(nth, wide[own])
    return p[0][own] + down, p[2][own] + right


def walk_pair(fps: np.ndarray, depth: int, node_a: int, node_b: int, budget: int = BUDGET, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, fingerprint) among the fingerprints below two nodes of the trie of `depth` bits."""
    f = np.unique(fps.astype(np.uint64))
    n = len(f)
    ones = np.zeros((64, n + 1), dtype=np.int32)
    for t in range(64):
        np.cumsum((f >> np.uint64(63 - t)) & np.uint64(1), out=ones[t, 1:])
    top = f >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    ends = [int(np.searchsorted(top, np.uint64(x), side=s)) for x in (node_a, node_b) for s in ("left", "right")]
    groups = _Groups(n)
    # columns: begin and end of either node, bits that differ so far
    stack = [(depth, np.array([[ends[0]], [ends[1]], [ends[2]], [ends[3]], [bin(node_a ^ node_b).count("1")]], dtype=np.int32))]
    while stack:
        t, p = stack.pop()
        if p.shape[1] > block:  # the last pairs, which differ least, come first
            stack.append((t, p[:, :-block]))
            p = p[:, -block:]
        p = p[:, ~groups.joined(p)]
        few = (p[1] - p[0]).astype(np.int64) * (p[3] - p[2]) <= LEAF_PAIRS
        if few.any():
            a, b = _leaves(p[:, few])
            near = np.bitwise_count(f[a] ^ f[b]) <= budget
            groups.link(a[near], b[near])
            p = p[:, ~few]
        if t == 64 or not p.shape[1]:
            continue
        mid_a = p[1] - (ones[t][p[1]] - ones[t][p[0]])
        mid_b = p[3] - (ones[t][p[3]] - ones[t][p[2]])
        other = p[0] != p[2]
        differ = [np.stack([p[0], mid_a, mid_b, p[3], p[4] + 1]), np.stack([mid_a, p[1], p[2], mid_b, p[4] + 1])[:, other]]
        equal = [np.stack([p[0], mid_a, p[2], mid_b, p[4]]), np.stack([mid_a, p[1], mid_b, p[3], p[4]])]
        p = np.concatenate([*differ, *equal], axis=1)
        p = p[:, (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)]
        if p.shape[1]:
            stack.append((t + 1, p))
    hung = np.flatnonzero(groups.label != np.arange(n))
    return f[groups.label[hung]].view(np.int64), f[hung].view(np.int64)


# --- the upper levels, on Spark ------------------------------------------------------------------


def _node(depth: int) -> Column:
    """The first depth bits of a fingerprint."""
    return F.shiftrightunsigned("fp", 64 - depth)


def node_pairs(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> list[tuple[int, DataFrame]]:
    """For each depth in use the pairs of nodes (a, b; a <= b) that are left to a task; none if the root is small."""
    small = min(SMALL_ROWS, node_rows)
    if fps.limit(small + 1).count() <= small:
        return []
    depth, out = FIRST_BITS, []
    step = F.sequence(F.lit(0), F.lit((1 << BITS) - 1))
    every = F.sequence(F.lit(0), F.lit((1 << FIRST_BITS) - 1))
    first = fps.sparkSession.range(1 << FIRST_BITS).select(F.col("id").alias("a"), F.explode(every).alias("b"))
    first = first.select("a", F.col("b").cast("long").alias("b")).where("a <= b")
    open_pairs = first.withColumn("bits", F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).where(F.col("bits") <= budget)
    while True:
        sizes = cut_lineage(fps.groupBy(_node(depth).alias("node")).agg(F.count(F.lit(1)).alias("rows")))
        two = sizes.select(F.col("node").alias("b"), F.col("rows").alias("rows_b"))
        pairs = open_pairs.join(sizes.select(F.col("node").alias("a"), F.col("rows").alias("rows_a")), "a").join(two, "b")
        size = F.when(F.col("a") == F.col("b"), F.col("rows_a")).otherwise(F.col("rows_a") + F.col("rows_b"))
        pairs = cut_lineage(pairs.select("a", "b", "bits", (size > node_rows).alias("large")))
        out.append((depth, pairs.where("not large").select("a", "b")))
        if depth == 64 or not pairs.where("large").limit(1).count():
            return out
        kids = pairs.where("large").select(F.col("a").alias("pa"), F.col("b").alias("pb"), "bits", F.explode(step).alias("x")).select("*", F.explode(step).alias("y"))
        kids = kids.withColumn("bits", F.col("bits") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).where(F.col("bits") <= budget)
        kids = kids.where((F.col("pa") < F.col("pb")) | (F.col("x") <= F.col("y")))
        open_pairs = kids.select((F.shiftleft("pa", BITS) + F.col("x")).alias("a"), (F.shiftleft("pb", BITS) + F.col("y")).alias("b"), "bits")
        depth += BITS


def _walker(depth: int, budget: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def walk(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        a, b = walk_pair(part["fp"].to_numpy(np.int64).view(np.uint64), depth, int(key[0]), int(key[1]), budget)
        return pd.DataFrame({"a": a, "b": b})

    return walk


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct fingerprints within the budget."""
    parts = []
    for depth, pairs in node_pairs(fps, budget, node_rows):
        ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))
        rows = fps.select("fp", _node(depth).alias("node")).join(ends, "node").select("a", "b", "fp")
        parts.append(rows.groupBy("a", "b").applyInPandas(_walker(depth, budget), "a long, b long"))
    if not parts:
        return fps.groupBy(F.lit(0).alias("a"), F.lit(0).alias("b")).applyInPandas(_walker(0, budget), "a long, b long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """k_id, k_h, fp, root, component_id for every row: root names the component (its smallest fingerprint), component_id
    is the smallest id among its documents.

    Null and empty texts and texts of white space have fingerprint 0 and are linked like others. Rows of a null id take
    part; a component of such rows only has a null id. Equal rows get equal results. An empty table gives no row.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col))
    fps = cut_lineage(own.groupBy("fp").agg(F.min(id_of()).alias("low")))
    roots = components(links(fps, budget))
    whole = fps.join(roots, fps.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = whole.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = cut_lineage(whole.join(ids, "root").select("fp", "root", "component_id"))
    return own.join(of_fp, "fp")


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group (k_id, k_h, root): that of the smallest id (a null id comes last), and among rows
    of that id the one with the smallest hash of its text. Of rows equal in id and text one stays.
    """
    a, b = unused(docs, "_id", "_hash")
    best = groups.groupBy("root").agg(F.min(F.struct(id_of().isNull(), "k_id", "k_h")).alias("best"))
    best = best.select(F.col("best.k_id").alias(a), F.col("best.k_h").alias(b)).distinct()
    rows = docs.withColumns({a: key_id(id_col), b: F.xxhash64(F.col(text_col))}).join(best, [a, b], "left_semi")
    return rows.dropDuplicates([a, b]).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The documents, one of each group of near copies; which one, see one_of_each()."""
    return one_of_each(docs, near_groups(docs, id_col, text_col, budget), id_col, text_col)
