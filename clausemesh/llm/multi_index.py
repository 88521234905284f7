"""Nearest neighbours by multi-index hashing over learned binary codes.

A code has WORDS words of 64 bits. Each word is a rotation of the vectors' principal axes, found by turns: bits are the
signs of the rotated values, and the rotation is the one that brings the values closest to those signs. Vectors are first
put on one sphere by a further component, sqrt(M^2 - |x|^2), which a query has as 0, so that the largest inner product is
the smallest angle.

The code is split into substrings of SUB bits, and every packed segment of the index has its rows ordered by each
substring. If two codes differ in at most r bits, they differ in at most t_j bits in at least one substring j, whenever
the sum of all t_j + 1 is r + 1. So a query looks up all values within t_j of its own substring j in the segment's list of
values, and the rows found this way hold every code within r. Those whose whole code lies within r are ranked by their
vectors, in double precision.

The axes, rotations and the radius are fitted on SAMPLE rows at most: the radius is that within which AIM of the true
neighbours of the sample's queries lie. Every row is indexed. In a larger table neighbours are nearer than in the sample,
so the share found is no smaller. Queries that find too few rows go on with larger radii until they have enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hard_negatives import usable
from .query_blocks import Batches, Best, column, in_blocks, lists, matrix, passes, stored

WORDS, SUB = 4, 16
BITS = 64 * WORDS
PARTS = BITS // SUB
SAMPLE, SAMPLE_QUERIES, AIM = 8192, 512, 0.95
TURNS = 30
QUERIES_AT_ONCE, SEGMENT_ROWS = 4096, 16384
#: One value in FEW is within the tolerance, or fewer: rows are looked up by value.
FEW = 64

_ROW = "id long, v array<double>, words array<long>, w0 long"
_SEGMENT = "ids array<long>, owners array<int>, vectors array<double>, words array<long>, orders array<int>"
_HIT = "query long, id long, score double"


# --- codes ---------------------------------------------------------------------------------------


@dataclass
class Codes:
    """Mean and principal axes of the sphere's vectors, one rotation for each word, the sphere's radius, and the Hamming
    radius of a search."""

    mean: np.ndarray
    axes: np.ndarray
    turns: list[np.ndarray]
    length: float
    radius: int = BITS

    def _words(self, sphere: np.ndarray) -> np.ndarray:
        z = (sphere - self.mean) @ self.axes
        bits = np.concatenate([z @ t > 0 for t in self.turns], axis=1)
        return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._words(_on_sphere(x, self.length))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return self._words(np.append(x * (self.length / np.maximum(norms, 1e-300)), np.zeros((len(x), 1)), axis=1))


def _on_sphere(x: np.ndarray, length: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(length**2 - (x * x).sum(axis=1), 0))
    return np.append(x, rest[:, None], axis=1)


def _turn(z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation of the axes onto 64 bits: signs and best rotation by turns."""
    t = np.linalg.qr(rng.normal(size=(64, z.shape[1])))[0].T
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(z.T @ np.where(z @ t > 0, 1.0, -1.0), full_matrices=False)
        t = u @ v
    return t


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of all codes a to all codes b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[:, w])
    return out


def fit(sample: np.ndarray, k: int, aim: float = AIM) -> Codes:
    """Codes fitted on the sample, and the radius that holds `aim` of the k nearest of each of its queries."""
    length = float(np.linalg.norm(sample, axis=1).max(initial=0)) or 1.0
    sphere = _on_sphere(sample, length)
    mean = sphere.mean(axis=0) if len(sphere) else np.zeros(sample.shape[1] + 1)
    values, vectors = np.linalg.eigh(np.cov((sphere - mean).T) if len(sphere) > 1 else np.eye(len(mean)))
    axes = vectors[:, np.argsort(-values)[:64]]
    rng = np.random.default_rng(5)
    z = (sphere - mean) @ axes
    codes = Codes(mean, axes, [_turn(z, rng) for _ in range(WORDS)], length)
    asked = sample[:SAMPLE_QUERIES]
    k = min(k, len(sample) - 1)
    if k > 0:
        scores = asked @ sample.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        far = np.take_along_axis(distances(codes.of_queries(asked), codes.of_rows(sample)), nearest, axis=1)
        codes.radius = int(np.quantile(far, aim, method="higher"))
    return codes


def tolerances(radius: int) -> list[int]:
    """How many bits each substring may differ in: the sum of all (tolerance + 1) is radius + 1; -1 is no look-up."""
    whole, more = divmod(radius + 1, PARTS)
    return [whole - 1 + (j < more) for j in range(PARTS)]


# --- the index -----------------------------------------------------------------------------------


def _substrings(words: np.ndarray) -> np.ndarray:
    """(rows, PARTS) of SUB bits each."""
    return words.astype(">u8").view(np.uint8).reshape(len(words), -1).view(">u2").astype(np.uint16)


def _coded(codes: Codes, size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            v = matrix(batch.column(1), size)
            words = codes.of_rows(v).view(np.int64)
            flat = [lists(v.ravel(), np.full(len(v), size)), lists(words.ravel(), np.full(len(v), WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *flat, pa.array(words[:, 0])], names=["id", "v", "words", "w0"])

    return run


def _packed(size: int) -> Callable[[Batches], Batches]:
    """Segments of rows sorted by code and vector. Equal vectors are stored once; owners has the vector of every id."""

    def segment(parts: list[tuple]) -> pa.RecordBatch:
        ids, v, words = (np.concatenate(p) for p in zip(*parts))
        new = np.ones(len(ids), bool)
        new[1:] = (v[1:] != v[:-1]).any(axis=1)
        owners = (np.cumsum(new) - 1).astype(np.int32)
        v, words = v[new], words[new]
        orders = np.argsort(_substrings(words), axis=0, kind="stable").T.astype(np.int32)
        cols = [ids, owners, v.ravel(), words.view(np.int64).ravel(), np.ascontiguousarray(orders).ravel()]
        return pa.RecordBatch.from_arrays([lists(c, [len(c)]) for c in cols], names=["ids", "owners", "vectors", "words", "orders"])

    def run(batches: Batches) -> Batches:
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), matrix(batch.column(1), size), matrix(batch.column(2), WORDS, np.int64).view(np.uint64)))
            rows += batch.num_rows
            if rows >= SEGMENT_ROWS:
                yield segment(held)
                held, rows = [], 0
        if rows:
            yield segment(held)

    return run


class _Segment:
    """A segment ready for look-ups: for each substring its values in order, and where the rows of a value begin."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids, owners = (column(batch, c, row) for c in ("ids", "owners"))
        self.first = np.searchsorted(owners, np.arange(owners[-1] + 2)) if len(owners) else np.zeros(1, np.int64)
        n = len(self.first) - 1
        self.v = column(batch, "vectors", row).reshape(n, -1)
        self.words = column(batch, "words", row).reshape(n, WORDS).view(np.uint64)
        self.orders = column(batch, "orders", row).reshape(PARTS, n)
        subs = _substrings(self.words)
        self.columns = np.ascontiguousarray(self.words.T)
        self.values, self.begin, self.place = [], [], np.zeros((PARTS, n), np.int32)
        for j in range(PARTS):
            value, begin, place = np.unique(subs[self.orders[j], j], return_index=True, return_inverse=True)
            self.values.append(value)
            self.begin.append(np.append(begin, n))
            self.place[j, self.orders[j]] = place

    def within(self, words: np.ndarray, subs: np.ndarray, radius: int, tolerance: list[int]) -> np.ndarray:
        """Rows whose code differs from the query's in at most `radius` bits."""
        seen = np.zeros(len(self.words), bool)
        for j in range(PARTS):
            if tolerance[j] < 0:
                continue
            hit = np.bitwise_count(self.values[j] ^ subs[j]) <= tolerance[j]
            near = np.flatnonzero(hit)
            if len(near) > len(hit) // FEW:  # many values: mark rows by the flag of their value
                seen |= hit[self.place[j]]
            elif len(near):
                begin, many = self.begin[j][near], self.begin[j][near + 1] - self.begin[j][near]
                places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                seen[self.orders[j][places]] = True
        rows = np.flatnonzero(seen)
        differ = np.zeros(len(rows), np.uint16)
        for w in range(WORDS):
            differ += np.bitwise_count(self.columns[w][rows] ^ words[w])
        return rows[differ <= radius]


def _search(block: dict, k: int) -> Callable[[Batches], Batches]:
    ids, v, words, radius = block["ids"], block["v"], block["words"], block["radius"]

    def run(batches: Batches) -> Batches:
        best = Best(k, len(ids), -np.inf)
        subs, tolerance = _substrings(words), tolerances(radius)
        for batch in batches:
            for row in range(batch.num_rows):
                seg = _Segment(batch, row)
                for q in range(len(ids)):
                    rows = seg.within(words[q], subs[q], radius, tolerance)
                    if not len(rows):
                        continue
                    scores = (seg.v[rows] * v[q]).sum(axis=1)
                    if len(rows) > k + 1:  # the query itself may be one of them
                        rows, scores = (x[scores >= np.partition(scores, -k - 1)[-k - 1]] for x in (rows, scores))
                    good = scores >= best.floor[q]
                    rows, scores = rows[good], scores[good]
                    # of equal vectors those with the smallest ids; no others can be among the k best
                    many = np.minimum(seg.first[rows + 1] - seg.first[rows], k + 1)
                    own = seg.ids[np.repeat(seg.first[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                    other = own != ids[q]
                    best.add(np.full(int(other.sum()), q), np.repeat(scores, many)[other], own[other])
                if best.size > 8 * k * len(ids):
                    best.cut()
        q, s, i = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], names=["query", "id", "score"])

    return run


# --- the operator --------------------------------------------------------------------------------


def nearest(rows: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """query_id, rank, the neighbour's id as vec_id, score: for every row that `query` marks, the k rows found that have the
    largest inner product with it, nearest first, ties by smaller id; all other rows, if there are not more.

    Vectors that are null, zero or hold a null or non-finite component, and rows of a null id, take no part. A shorter
    vector goes on with zeros. A row never finds a row of its own id; rows equal in id and vector count once; of queries of
    one id, the one with the smallest vector is asked. Other columns have no effect. An empty table gives no row.
    """
    own = rows.where(F.col(id_col).isNotNull() & usable(vector_col) & F.exists(F.col(vector_col), lambda x: x != 0))
    own = own.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), query.alias("asked"))
    size = own.agg(F.max(F.size("v"))).first()[0] or 1
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    codes = fit(matrix(sample, size), k, aim)

    table = own.select("id", "v").mapInArrow(_coded(codes, size), _ROW)
    table = table.repartitionByRange("w0", F.xxhash64("v"), "id").sortWithinPartitions("w0", "v", "id")
    index = stored(table.select("id", "v", "words").mapInArrow(_packed(size), _SEGMENT), "codes-index")
    open_ = stored(own.where(F.coalesce("asked", F.lit(False))).groupBy("id").agg(F.min("v").alias("v")), "codes-queries")

    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    done, radius = None, codes.radius
    while True:

        def blocks(radius: int = radius, asked: DataFrame = open_) -> Iterator[dict]:
            for found in in_blocks(asked, QUERIES_AT_ONCE):
                v = matrix(found["v"].combine_chunks(), size)
                yield {"ids": found["id"].to_numpy(), "v": v, "words": codes.of_queries(v), "radius": radius}

        hits = passes(index, blocks(), lambda b: _search(b, k), _HIT, "codes-hits").distinct()
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        enough = hits.groupBy("query").count().where(F.col("count") >= k) if radius < BITS else hits.select("query").distinct()
        found = stored(hits.join(enough.select("query"), "query", "left_semi"), "codes-found")
        done = found if done is None else done.unionByName(found)
        if radius >= BITS:
            break
        open_ = stored(open_.join(found.select(F.col("query").alias("id")).distinct(), "id", "left_anti"), "codes-left")
        if not open_.limit(1).count():
            break
        radius = min(BITS, radius + BITS // 8)
    return done.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
