"""Hard-negative mining with angular triangle filtering, over whole-number vectors.

Every row keeps its norm and its angles to a few reference directions. On the sphere, the angle of two vectors lies
between the difference and the sum of their angles to any third direction (the sum taken back from beyond pi), so each
reference gives an interval for the cosine, and the intervals of all references are cut with each other. Times the two
norms, widened by more than the rounding of angles and cosines can be, that bounds the whole-number score from both
sides. Only pairs whose bounds overlap a window still open are scored, exactly.

Two passes for each block of anchors over the packed rows: the first finds the positives of every anchor (its window is
all from the k-th best score so far), the second the negatives of every positive: scores from low to high percent of the
positive's score, and not below the k-th best of that window so far. Rows are packed in the order of their nearest
reference and the angle to it, and a tile of them has an interval of angles of its own, so that tiles are skipped whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unused
from .query_blocks import Batches, Best, column, in_blocks, lists, matrix, passes, stored

POSITIVES = NEGATIVES = 5
LOW, HIGH = 80, 100
#: Directions, and the rows they are chosen from (by the hash of the id). They decide the speed alone.
REFERENCES, SAMPLE = 16, 4096
ANCHORS_AT_ONCE, SEGMENT_ROWS, TILE = 4096, 8192, 512
#: Far more than the error of an angle by arccos of a double, which is below 1e-7 even at its worst, near 0 and pi.
SLACK = 1e-6
LOWEST = -(2**62)
EXACT = 2.0**52

_SEGMENT = "ids array<long>, labels array<long>, vectors array<long>, norms array<double>, angles array<double>"
_HIT = "anchor long, place int, id long, score long"


# --- angles --------------------------------------------------------------------------------------


def directions(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """n unit vectors at most: far from each other first, then moved to the mean of the vectors nearest to them."""
    lengths = np.linalg.norm(sample, axis=1)
    unit = sample[lengths > 0] / lengths[lengths > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    for _ in range(min(n, len(unit)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    out = unit[chosen]
    for _ in range(4):
        of = (unit @ out.T).argmax(axis=1)
        for i in range(len(out)):
            mean = unit[of == i].sum(axis=0)
            if np.linalg.norm(mean) > 1e-9:
                out[i] = mean / np.linalg.norm(mean)
    return out


def angles_to(vectors: np.ndarray, norms: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """(rows, references); a zero vector has angles of 0, which its norm of 0 makes harmless."""
    return np.where(norms[:, None] > 0, np.arccos(np.clip(vectors @ refs.T / np.maximum(norms, 1e-300)[:, None], -1, 1)), 0.0)


def bounds(one: np.ndarray, norm_one: np.ndarray, low: np.ndarray, high: np.ndarray, norm_low: np.ndarray, norm_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of vectors `one` (rows, references) with each of others, whose angles lie in low .. high
    and norms in norm_low .. norm_high: two matrices (rows, others) of doubles, rounded to the safe side."""
    least, most = np.zeros((len(one), len(low))), np.full((len(one), len(low)), np.pi)
    for r in range(one.shape[1]):
        a = one[:, r, None]
        np.maximum(least, np.maximum(low[:, r] - a, a - high[:, r]), out=least)
        np.minimum(most, np.minimum(a + high[:, r], 2 * np.pi - a - low[:, r]), out=most)
    up, down = np.cos(np.maximum(least - SLACK, 0)), np.cos(np.minimum(most + SLACK, np.pi))
    small, large = norm_one[:, None] * norm_low, norm_one[:, None] * norm_high
    pad = 1 + 1e-9 * large
    return np.minimum(down * small, down * large) - pad, np.maximum(up * small, up * large) + pad


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All whole-number inner products. Doubles are exact where the norms say so; else 64-bit integers are used."""
    most = np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0)
    if most < EXACT:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


# --- packed rows ---------------------------------------------------------------------------------


def _described(refs: np.ndarray, size: int) -> Callable[[Batches], Batches]:
    """(id, label, v) to (id, label, v, norm, angles, cell, near)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            v = matrix(batch.column(2), size)
            norms = np.linalg.norm(v, axis=1)
            angles = angles_to(v, norms, refs)
            cell = angles.argmin(axis=1) if len(refs) else np.zeros(len(v), np.int64)
            near = angles[np.arange(len(v)), cell] if len(refs) else np.zeros(len(v))
            flat = lists(angles.ravel(), np.full(len(v), len(refs)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), flat, pa.array(cell), pa.array(near)], names=["id", "label", "v", "norm", "angles", "cell", "near"])

    return run


def _packed(n_refs: int, size: int) -> Callable[[Batches], Batches]:
    """Segments of sorted rows; of rows that are equal in all, one stays."""

    def segment(parts: list[tuple]) -> pa.RecordBatch:
        ids, labels, v, norms, angles = (np.concatenate(p) for p in zip(*parts))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (v[1:] != v[:-1]).any(axis=1)
        cols = [ids[new], labels[new], v[new].ravel(), norms[new], angles[new].ravel()]
        return pa.RecordBatch.from_arrays([lists(c, [len(c)]) for c in cols], names=["ids", "labels", "vectors", "norms", "angles"])

    def run(batches: Batches) -> Batches:
        held, rows = [], 0
        for batch in batches:
            get = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            held.append((get(0), get(1), matrix(batch.column(2), size, np.int64), get(3), matrix(batch.column(4), n_refs)))
            rows += batch.num_rows
            if rows >= SEGMENT_ROWS:
                yield segment(held)
                held, rows = [], 0
        if rows:
            yield segment(held)

    return run


class _Rows:
    """The rows of a segment, in tiles."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids, self.labels, self.norms = (column(batch, c, row) for c in ("ids", "labels", "norms"))
        n = len(self.ids)
        self.v = column(batch, "vectors", row).reshape(n, -1)
        self.angles = column(batch, "angles", row).reshape(n, -1)

    def tiles(self) -> Iterator[slice]:
        for i in range(0, len(self.ids), TILE):
            yield slice(i, min(i + TILE, len(self.ids)))


def _scan(block: dict, open_: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], of_tile: Callable[[np.ndarray, np.ndarray, np.ndarray], None], same: bool) -> Callable[[Batches], None]:
    """Give every tile's scored pairs (anchor, score, id) to of_tile. open_(anchors, least, most) tells which bounds
    overlap an open window of these anchors; `same` asks for rows of the anchor's label, else of other labels."""

    def run(batches: Batches) -> None:
        v, norms, angles, labels, ids = (block[k] for k in ("v", "norms", "angles", "labels", "ids"))
        every = np.arange(len(ids))
        for batch in batches:
            for row in range(batch.num_rows):
                seg = _Rows(batch, row)
                for t in seg.tiles():
                    a, n = seg.angles[t], seg.norms[t]
                    least, most = bounds(angles, norms, a.min(axis=0)[None], a.max(axis=0)[None], n.min(keepdims=True), n.max(keepdims=True))
                    some = every[open_(every, least, most)[:, 0]]
                    if same:
                        some = some[np.isin(labels[some], seg.labels[t])]
                    if not len(some):
                        continue
                    fits = (labels[some, None] == seg.labels[t]) == same
                    fits &= ids[some, None] != seg.ids[t]
                    least, most = bounds(angles[some], norms[some], a, a, n, n)
                    fits &= open_(some, least, most)
                    rows, cols = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
                    if len(rows):
                        scores = products(v[some[rows]], seg.v[t][cols])
                        i, j = np.nonzero(fits[np.ix_(rows, cols)])
                        of_tile(some[rows[i]], scores[i, j], seg.ids[t][cols[j]])

    return run


def _positives(block: dict, k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        best = Best(k, len(block["ids"]), LOWEST)

        def take(anchor: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
            good = score >= best.floor[anchor]
            best.add(anchor[good], score[good], name[good])
            if best.size > 4 * k * len(best.floor):
                best.cut()

        _scan(block, lambda some, least, most: most >= best.floor[some, None], take, True)(batches)
        q, s, i = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][q]), pa.array(np.zeros(len(q), np.int32)), pa.array(i), pa.array(s)], names=["anchor", "place", "id", "score"])

    return run


def _negatives(block: dict, k: int) -> Callable[[Batches], Batches]:
    low, high = block["low"], block["high"]  # (anchors, positives); low > high where there is no window
    places = low.shape[1]

    def run(batches: Batches) -> Batches:
        best = Best(k, low.size, LOWEST)

        def open_(some: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
            out = np.zeros(least.shape, bool)
            floor = np.maximum(low, best.floor.reshape(low.shape))[some]
            for p in range(places):
                out |= (least <= high[some, p, None]) & (most >= floor[:, p, None]) & (low[some, p, None] <= high[some, p, None])
            return out

        def take(anchor: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
            for p in range(places):
                q = anchor * places + p
                good = (score >= low[anchor, p]) & (score <= high[anchor, p]) & (score >= best.floor[q])
                best.add(q[good], score[good], name[good])
            if best.size > 4 * k * low.size:
                best.cut()

        _scan(block, open_, take, False)(batches)
        q, s, i = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][q // places]), pa.array((q % places + 1).astype(np.int32)), pa.array(i), pa.array(s)], names=["anchor", "place", "id", "score"])

    return run


# --- the operator --------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """Vectors without a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector), fine), F.lit(False))


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _block(found: pa.Table, refs: np.ndarray, size: int) -> dict:
    v = matrix(found["v"].combine_chunks(), size, np.int64)
    norms = np.linalg.norm(v.astype(float), axis=1)
    ids = found["id"].to_numpy()
    order = np.argsort(ids)
    return {"ids": ids[order], "labels": found["label"].to_numpy()[order], "v": v[order], "norms": norms[order], "angles": angles_to(v, norms, refs)[order]}


def _windows(block: dict, found: pa.Table, k: int, low: int, high: int) -> dict:
    """The block with the score windows of its positives (anchor, rank, score), for anchors that have any."""
    at = np.searchsorted(block["ids"], found["anchor"].to_numpy())
    place, score = found["place"].to_numpy() - 1, found["score"].to_numpy()
    lows, highs = np.full((len(block["ids"]), k), 1, np.int64), np.zeros((len(block["ids"]), k), np.int64)
    lows[at, place], highs[at, place] = -((-low * score) // 100), (high * score) // 100
    some = np.zeros(len(block["ids"]), bool)
    some[at] = True
    return {c: x[some] for c, x in (block | {"low": lows, "high": highs}).items()}


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, references: int = REFERENCES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows have whole numbers as ids, labels and vector components; `anchor` marks the anchors. A score is an inner product;
    higher scores come first, ties by smaller id. Of each of an anchor's first `positives` other rows of its label, the
    first `negatives` rows of other labels whose score is low to high percent of the positive's, both ends included.

    Rows of a null id, label, vector or component take no part. A shorter vector goes on with zeros, so an empty one is
    zero and scores 0. Rows equal in id, label and vector count once; a row never meets another row of its own id; of an
    anchor's rows of one id, the one with the smallest label and vector is the anchor. Other columns have no effect. An
    empty table, and an anchor without positives or negatives, give no row.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"), anchor.alias("anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    size = own.agg(F.max(F.size("v"))).first()[0] or 1
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    refs = directions(matrix(sample, size), references)
    small = "id long, label long, v array<long>"
    table = own.select("id", "label", "v").mapInArrow(_described(refs, size), f"{small}, norm double, angles array<double>, cell long, near double")
    table = table.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id", "label", "v")
    index = stored(table.select("id", "label", "v", "norm", "angles").mapInArrow(_packed(len(refs), size), _SEGMENT), "negatives-rows")
    ones = own.where(F.coalesce("anchor", F.lit(False))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("s"))
    ones = stored(ones.select("id", "s.label", "s.v"), "negatives-anchors")

    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    blocks = lambda: (_block(found, refs, size) for found in in_blocks(ones, ANCHORS_AT_ONCE))
    near = passes(index, blocks(), lambda b: _positives(b, positives), _HIT, "negatives-positives").distinct()
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = stored(near.select("anchor", "place", "id", "score"), "negatives-ranked")

    def windows() -> Iterator[dict]:
        for block in blocks():
            mine_ = near.join(F.broadcast(spark.createDataFrame([(int(i),) for i in block["ids"]], "anchor long")), "anchor", "left_semi").toArrow()
            if mine_.num_rows:
                yield _windows(block, mine_, positives, low, high)

    far = passes(index, windows(), lambda b: _negatives(b, negatives), _HIT, "negatives-negatives").distinct()
    first = W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    far = far.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(far, ["anchor", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """mine() over floating vectors as multiples of 1/256, rounded down: labels of ids divisible by 7 move on by one of 10,
    anchors are the ids divisible by 100. Rows with a null or non-finite component take no part."""
    name, label = unused(embeddings, "_numbers", "_moved")
    rows = embeddings.where(usable(vector_col)).withColumns({
        name: whole_numbers(F.col(vector_col)),
        label: F.when(F.col(id_col) % 7 == 0, (F.col(label_col).cast("long") + 1) % 10).otherwise(F.col(label_col).cast("long")),
    })
    return mine(rows, F.col(id_col) % 100 == 0, id_col, name, label)
