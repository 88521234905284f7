"""Quality classifier by co-training.

Two views of a document: its content (which of the selected words it holds, and shape figures such as the share of
repeated words or of punctuation) and its metadata (source, language, and the text's length and number of lines). A
logistic model of each view is fitted on labelled documents. In each round, each model scores every unlabelled text of the
corpus and hands its surest ones to the other model, which is fitted again: those beyond the odds of its surest TAIL of the
held-out documents on either side, GIVEN different texts of each class at most. How often a view is right in that tail is
measured on the held-out documents, and a pseudo-label weighs as much as its view is better than chance there; a tail
that is right less often than SURE hands over nothing. In the end each view is calibrated on the held-out documents,
which no fit and no choice of words has seen, the two calibrated log-odds are combined by a last logistic model, and all
documents are scored. A document is good if its quality is 1 and it is not toxic. Words are chosen for poor and for toxic
documents apart, and a model of its own tells toxic content from other; a document's score is never above its probability
of not being toxic.

The fits run on the driver on a bounded sample: at most MAX_LABELLED labelled texts, one of each labelled id, chosen by the
hash of the id, and 2 x GIVEN pseudo-labelled ones for each view and round. Everything else covers all documents: the texts
are read once to choose words (sampled rows only) and once to turn every document into a small row of figures, on which
rounds and scores run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import give_back_memory, id_of, key_id, small_batches, unused
from .words import Block, blocks

MAX_LABELLED = 20_000
ROUNDS = 2
GIVEN = 500
TAIL, SURE = 0.1, 0.6
BUCKETS = 1 << 20
MAX_WORDS = 512
MIN_DOCS = 4
MIN_Z = 5.0
THRESHOLD = 0.5
HELD_OUT = 0.25
SHAPES = 9
SOURCES = 64
SIZES = 24
_META = 2 * SOURCES + 4 + 2 * SIZES


# --- figures of a text ---------------------------------------------------------------------------


def _shapes(block: Block, raw_upper: np.ndarray) -> np.ndarray:
    """Per document: words, mean length of words, share of different words, of the most frequent one, of words that
    repeat the one before, of non-word bytes, of blanks, of capitals, and of digits; logs and shares, all about 0 to 1."""
    n = np.maximum(block.n_words, 1).astype(float)
    count = len(block.n_words)
    size = np.maximum(np.diff(np.append(block.offsets, len(block.low))), 1).astype(float)
    lengths = np.bincount(block.doc, weights=block.ends - block.starts, minlength=count)
    order = np.lexsort((block.hashes, block.doc))
    d, h = block.doc[order], block.hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(count)
    np.maximum.at(most, d[new], runs)
    again = (block.hashes[1:] == block.hashes[:-1]) & (block.doc[1:] == block.doc[:-1])
    by_doc = lambda flags: np.add.reduceat(np.append(flags, 0).astype(float), block.offsets) * (np.diff(np.append(block.offsets, len(block.low))) > 0)
    low = block.low
    punctuation = by_doc(((low < 48) | ((low > 57) & (low < 97)) | ((low > 122) & (low < 128))) & (low > 32))
    return np.stack([
        np.log1p(block.n_words) / 10, lengths / n / 10, np.bincount(d[new], minlength=count) / n, most / n,
        np.bincount(block.doc[1:][again], minlength=count) / n, punctuation / size * 5, by_doc(low <= 32) / size * 5, by_doc(raw_upper) / size * 2,
        by_doc((low >= 48) & (low < 58)) / size * 5,
    ], axis=1)


def _buckets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Every word bucket of every document once: documents and buckets."""
    both = np.unique((block.doc.astype(np.int64) << 20) | (block.hashes & np.uint64(BUCKETS - 1)).astype(np.int64))
    return both >> 20, both & (BUCKETS - 1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, good, bad): in how many documents of the task's rows a word occurs. Column 0 is 1 for a good document."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        good = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
        for block in blocks(batch.column(1)):
            doc, bucket = _buckets(block)
            np.add.at(counts, (good[block.first + doc], bucket), 1)
    found = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[1, found].astype(np.int64)), pa.array(counts[0, found].astype(np.int64))], names=["bucket", "good", "bad"])


def choose_words(sample: DataFrame) -> np.ndarray:
    """Buckets of words whose share of good and bad documents differs by MIN_Z standard errors, MAX_WORDS at most.

    sample: (good, text). Only words in MIN_DOCS documents or more count."""
    n = sample.groupBy("good").count().collect()
    total = {r["good"]: r["count"] for r in n}
    good, bad = total.get(1, 0), total.get(0, 0)
    if not good or not bad:
        return np.zeros(0, np.int64)
    counts = sample.select("good", "text").mapInArrow(_word_counts, "bucket long, good long, bad long").groupBy("bucket").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    share = (F.col("g") + F.col("b")) / F.lit(good + bad)
    error = F.sqrt(share * (1 - share) * F.lit(1 / good + 1 / bad)) + F.lit(1e-9)
    z = F.abs(F.col("g") / F.lit(good) - F.col("b") / F.lit(bad)) / error
    rows = counts.where(F.col("g") + F.col("b") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z)
    return np.sort(np.array([r["bucket"] for r in rows.orderBy(F.desc("z"), "bucket").limit(MAX_WORDS).collect()], dtype=np.int64))


def _figures(words: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map (k_id, k_h, text, metadata) to (k_id, k_h, shapes, words present, metadata)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int16)
        place[words] = np.arange(len(words))
        for batch in batches:
            column = batch.column(2)
            shapes, present = [], []
            for block in blocks(column):
                shapes.append(_shapes(block, block.upper))
                doc, bucket = _buckets(block)
                at = place[bucket]
                doc, at = doc[at >= 0], at[at >= 0]
                present += [x.tolist() for x in np.split(at, np.searchsorted(doc, np.arange(1, len(block.n_words))))]
            flat = np.concatenate(shapes).astype(np.float32) if shapes else np.zeros((0, SHAPES), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) * SHAPES + 1, SHAPES, dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists, pa.array(present, type=pa.list_(pa.int16())), batch.column(3)], names=["k_id", "k_h", "shapes", "present", "meta"]
            )
        give_back_memory()

    return run


def _metadata(text: str, source: str, lang: str):
    """Positions of the metadata figures that are set (source and language hashed), and four numbers."""
    hashed = lambda c, base: (F.lit(base) + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(SOURCES))).cast("float")
    chars = F.coalesce(F.length(text), F.lit(0))
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    numbers = [F.log1p(chars) / 10, F.log1p(lines) / 5, F.log1p(chars / lines) / 10, F.when(F.col(source).isNull() | F.col(lang).isNull(), 1.0).otherwise(0.0)]
    return F.array(hashed(source, 0), hashed(lang, SOURCES), *[n.cast("float") for n in numbers])


# --- the models ----------------------------------------------------------------------------------


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        own = self.weights / self.scale
        return x @ own.astype(x.dtype) + (self.bias - float(self.mean @ own))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300, dense: int | None = None, weights: np.ndarray | None = None) -> Logistic:
    """Full-batch Adam on the weighted mean log loss with an L2 penalty. Only the first `dense` columns are standardised,
    for which x is changed and changed back, so that there is no second copy of it."""
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    k = x.shape[1] if dense is None else dense
    part = np.ones(len(y)) if weights is None else weights
    part = part / max(part.sum(), 1e-9)
    own = x[:, :k].copy()
    if len(x):
        mean[:k], scale[:k] = _standard(own.astype(float))
    x[:, :k] = (own - mean[:k]) / scale[:k]
    w = np.zeros(x.shape[1] + 1)
    if len(y):
        share = np.clip(part @ y, 1e-3, 1 - 1e-3)
        w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        e = (p - y) * part
        g = np.append(x.T @ e.astype(x.dtype) + penalty * w[:-1], e.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    x[:, :k] = own
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def content_matrix(shapes: list, present: list, n_words: int) -> np.ndarray:
    """Shape figures, their squares, and a column for each selected word."""
    base = np.stack([np.asarray(s, np.float32) for s in shapes]) if len(shapes) else np.zeros((0, SHAPES), np.float32)
    out = np.zeros((len(base), 2 * SHAPES + n_words), np.float32)
    out[:, :SHAPES], out[:, SHAPES : 2 * SHAPES] = base, base * base
    for i, p in enumerate(present):
        if len(p):
            out[i, 2 * SHAPES + np.asarray(p, np.int64)] = 1
    return out


def meta_matrix(meta: list) -> np.ndarray:
    rows = np.stack([np.asarray(m, np.float32) for m in meta]) if len(meta) else np.zeros((0, 6), np.float32)
    out = np.zeros((len(rows), _META), np.float32)
    at = np.arange(len(rows))
    out[:, :4] = rows[:, 2:]
    out[at, 4 + rows[:, 0].astype(int)] = 1
    out[at, 4 + rows[:, 1].astype(int)] = 1
    for i, (column, unit) in enumerate(((2, 10), (3, 5))):  # doublings of length and of lines
        out[at, 4 + 2 * SOURCES + i * SIZES + np.minimum(rows[:, column] * (unit / np.log(2)), SIZES - 1).astype(int)] = 1
    return out


@dataclass
class CoTrained:
    content: Logistic
    meta: Logistic
    calibration: tuple[tuple[float, float], tuple[float, float]]
    combination: Logistic
    n_words: int
    clean: Logistic | None = None
    clean_scale: tuple[float, float] = (1.0, 0.0)
    #: For each round what the content view and the metadata view handed over: good and bad documents.
    given: tuple[tuple[tuple[int, int], tuple[int, int]], ...] = ()

    def odds(self, frame: pd.DataFrame) -> np.ndarray:
        """Calibrated log-odds of both views: (rows, 2)."""
        views = (self.content.odds(content_matrix(frame["shapes"], frame["present"], self.n_words)), self.meta.odds(meta_matrix(frame["meta"])))
        return np.stack([a * v + b for v, (a, b) in zip(views, self.calibration)], axis=1)

    def scores(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        odds = self.odds(frame)
        least = self.combination.odds(odds)
        if self.clean is not None:
            a, b = self.clean_scale
            least = np.minimum(least, a * self.clean.odds(content_matrix(frame["shapes"], frame["present"], self.n_words)) + b)
        return odds, 1 / (1 + np.exp(-np.clip(least, -30, 30)))


def _platt(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    if len(np.unique(y)) < 2:
        return 1.0, 0.0
    own = fit_logistic(odds[:, None], y, penalty=1e-4, steps=400)
    a = float(own.weights[0] / own.scale[0])
    return a, float(own.bias - a * own.mean[0])


# --- co-training ---------------------------------------------------------------------------------


def _labels(labels: DataFrame, limit: int) -> DataFrame:
    """k_id, good, rich and clean (1 or 0; the last two are null without a label of quality or toxic): at most `limit` rows,
    by the hash of the id. A document with labels that disagree is bad; a document without any label value is none."""
    rows = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = rows.groupBy(key_id("doc_id").alias("k_id")).agg(
        F.min(good.cast("int")).alias("good"), F.min((F.col("quality") == 1).cast("int")).alias("rich"), F.min((F.col("toxic") == 0).cast("int")).alias("clean")
    )
    return rows.orderBy(F.xxhash64("k_id"), "k_id").limit(limit)


def labelled_texts(keys: DataFrame, known: DataFrame) -> DataFrame:
    """k_h, good, rich, clean, held: one text of each labelled id (the smallest hash), each text once. Labels of equal texts
    are combined like labels of one document. held marks the HELD_OUT that only calibration and measures see."""
    one = keys.join(F.broadcast(known), "k_id").groupBy("k_id", "good", "rich", "clean").agg(F.min("k_h").alias("k_h"))
    rows = one.groupBy("k_h").agg(*[F.min(c).alias(c) for c in ("good", "rich", "clean")])
    return rows.withColumn("held", F.pmod(F.xxhash64("k_h", F.lit("held")), F.lit(1000)) < int(1000 * HELD_OUT))


_EVERY = ["k_h", "shapes", "present", "meta"]


def _surest(figures: DataFrame, columns: list[str], odds: Callable[[pd.DataFrame], np.ndarray], edges: tuple[float, float], given: int) -> pd.DataFrame:
    """The unlabelled texts of the highest and lowest log-odds beyond the edges, `given` of each, ties by the text's hash."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series(np.asarray(odds(frame), float))

    rows = figures.where("good is null").select("k_h", score(F.struct(*columns)).alias("odds"))
    rows = rows.where((F.col("odds") <= edges[0]) | (F.col("odds") >= edges[1])).groupBy("k_h").agg(F.max("odds").alias("odds"))
    top = rows.where(F.col("odds") >= edges[1]).orderBy(F.desc("odds"), F.hash("k_h"), "k_h").limit(given).select("k_h", F.lit(1).alias("good"))
    low = rows.where(F.col("odds") <= edges[0]).orderBy("odds", F.hash("k_h"), "k_h").limit(given).select("k_h", F.lit(0).alias("good"))
    chosen = F.broadcast(top.union(low).dropDuplicates(["k_h"]))
    return figures.select(*_EVERY).join(chosen, "k_h").dropDuplicates(["k_h"]).toArrow().to_pandas().sort_values("k_h", ignore_index=True)


def _tail(odds: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    """Edges of the surest TAIL of held-out documents on the bad and on the good side, and the weight of a pseudo-label
    there: 2 p - 1, p the share that is right, or 0 and an edge that nothing reaches if p is below SURE."""
    edges, weights = [-np.inf, np.inf], [0.0, 0.0]
    for side, sign in ((0, -1), (1, 1)):
        edge = np.quantile(sign * odds, 1 - TAIL)
        inside = sign * odds >= edge
        p = ((y[inside] == side).sum() + 1) / (inside.sum() + 2)
        if p >= SURE:
            edges[side], weights[side] = float(sign * edge), 2 * float(p) - 1
    return (edges[0], edges[1]), (weights[0], weights[1])


def co_train(figures: DataFrame, n_words: int, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained | None:
    """Fit both views on figures (k_h, shapes, present, meta, good, clean, held); None without labels of both classes."""
    known = figures.where("good is not null").select(*_EVERY, "good", "clean", "held").dropDuplicates(["k_h"])
    known = known.toArrow().to_pandas().sort_values("k_h", ignore_index=True)  # toPandas() makes a Python object of every number
    if known["good"].nunique() < 2:
        return None
    held = known["held"].to_numpy(bool)
    if known["good"][held].nunique() < 2 or known["good"][~held].nunique() < 2:
        held = np.zeros(len(known), bool)  # too few labels to hold any out
    test = known[held] if held.any() else known
    learn = known[~held].assign(weight=1.0)
    content = lambda f: content_matrix(f["shapes"], f["present"], n_words)
    read = (content, lambda f: meta_matrix(f["meta"]))
    columns = (["shapes", "present"], ["meta"])
    fit = lambda i, f: fit_logistic(
        read[i](f), f["good"].to_numpy(float), penalty=(1e-3, 1e-2)[i], dense=(2 * SHAPES, 4)[i], weights=f["weight"].to_numpy(float)
    )
    y = test["good"].to_numpy(float)
    sets, counts = [learn, learn], []
    models = [fit(i, sets[i]) for i in (0, 1)]
    for _ in range(rounds):
        found = []
        for i in (0, 1):
            edges, weights = _tail(models[i].odds(read[i](test)), y)
            more = _surest(figures, columns[i], lambda f, i=i, m=models[i]: m.odds(read[i](f)), edges, given)
            found.append(more.assign(weight=more["good"].map({0: weights[0], 1: weights[1]}).astype(float)))
        counts.append(tuple((int((f["good"] == 1).sum()), int((f["good"] == 0).sum())) for f in found))
        for i in (0, 1):
            more = found[1 - i]
            sets[i] = pd.concat([sets[i], more[~more["k_h"].isin(sets[i]["k_h"])]], ignore_index=True)
        models = [fit(i, sets[i]) for i in (0, 1)]
    scales = tuple(_platt(models[i].odds(read[i](test)), y) for i in (0, 1))
    odds = np.stack([a * models[i].odds(read[i](test)) + b for i, (a, b) in enumerate(scales)], axis=1).astype(float)
    clean, clean_scale = None, (1.0, 0.0)
    if known["clean"].nunique() == 2:
        told = known["clean"].notna().to_numpy()
        some, prove = known[told & ~held], known[told & held]
        if some["clean"].nunique() < 2 or prove["clean"].nunique() < 2:
            some = prove = known[told]
        clean = fit_logistic(content(some), some["clean"].to_numpy(float), dense=2 * SHAPES)
        clean_scale = _platt(clean.odds(content(prove)), prove["clean"].to_numpy(float))
    return CoTrained(models[0], models[1], scales, fit_logistic(odds, y, penalty=1e-4, steps=400), n_words, clean, clean_scale, tuple(counts))


def figures_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, max_labelled: int) -> tuple[DataFrame, int]:
    """(k_id, k_h, shapes, present, meta, good, clean, held) of every row, and the number of selected words."""
    small_batches(docs.sparkSession)
    own = docs.select(key_id(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_h"), F.col(text_col).alias("text"), _metadata(text_col, source_col, lang_col).alias("meta"))
    known = cut_lineage(labelled_texts(own.select("k_id", "k_h"), _labels(labels, max_labelled)))
    learn = known.where("not held") if known.where("not held").select("good").distinct().count() == 2 else known
    sample = own.select("k_h", "text").join(F.broadcast(learn), "k_h").dropDuplicates(["k_h"])
    apart = [choose_words(sample.where(F.col(c).isNotNull()).select(F.col(c).alias("good"), "text")) for c in ("rich", "clean")]
    words = np.union1d(*apart)
    figures = own.select("k_id", "k_h", "text", "meta").mapInArrow(_figures(words), "k_id long, k_h long, shapes array<float>, present array<smallint>, meta array<float>")
    return cut_lineage(figures.join(F.broadcast(known.select("k_h", "good", "clean", "held")), "k_h", "left")), len(words)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD,
) -> DataFrame:
    """k_id, k_h, content_score, meta_score, score (probabilities of a good document), keep; once for equal documents.

    labels: doc_id, quality, toxic. Null and empty texts have no words and are scored like others; null sources and
    languages are values of their own. Without labels of both classes nothing can be learned: scores are null and every
    document is kept. An empty table gives no row.
    """
    figures, n_words = figures_of(docs, labels, id_col, text_col, source_col, lang_col, max_labelled)
    model = co_train(figures, n_words)
    if model is None:
        empty = F.lit(None).cast("double")
        return figures.select("k_id", "k_h", empty.alias("content_score"), empty.alias("meta_score"), empty.alias("score"), F.lit(True).alias("keep"))

    @F.pandas_udf("content_score double, meta_score double, score double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            odds, p = model.scores(frame)
            views = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pd.DataFrame({"content_score": views[:, 0], "meta_score": views[:, 1], "score": p})

    scored = figures.select("k_id", "k_h", score(F.struct("shapes", "present", "meta")).alias("s")).select("k_id", "k_h", "s.*")
    return scored.withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; equal rows are kept or go together."""
    a, b = unused(docs, "_id", "_hash")
    bad = classify(docs, labels, id_col, text_col, **columns).where("not keep").select(F.col("k_id").alias(a), F.col("k_h").alias(b)).distinct()
    rows = docs.withColumns({a: key_id(id_col), b: F.xxhash64(F.col(text_col))})
    return rows.join(bad, [a, b], "left_anti").select(*docs.columns)
