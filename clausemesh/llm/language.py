"""Language id: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Each byte of a text is one step. A segment of SEGMENT bytes is read from both ends by two gated recurrent units (update
and reset gate, with clipped linear gates in place of the exponential ones, so a step is a few cheap array operations);
the two states at a byte give the probabilities of its language. A document's probabilities are the mean over the bytes
of its letters. Every byte of a text is read: a text is cut into segments, the last one padded.

The net is fitted on the driver on a bounded sample: at most DOCS_PER_LANG documents of each language, chosen by the
hash of their id, and of each at most SEGMENTS_PER_DOC segments spread evenly over the whole text. Prediction runs in
Arrow batches on all documents, with the net (some thousands of numbers) sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import first_rows
from .common import small_batches, unused
from .words import strings

SEGMENT = 64
HIDDEN = 8
BATCH = 2048
DOCS_PER_LANG = 400
EXTRA = 8
SEGMENTS_PER_DOC = 8
STEPS = 260
TRAIN_BATCH = 384
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Net:
    """For each direction a table of what a byte adds to the gates (3 x hidden, 256) and recurrent weights; output weights."""

    langs: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recurrent, self.out, self.bias]


def new_net(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    table, recurrent = [], []
    for _ in range(2):
        t = rng.normal(0, 0.15, (3 * hidden, 256)).astype(np.float32)
        t[:hidden] += 0.4
        t[hidden : 2 * hidden] += 0.6
        table.append(t)
        recurrent.append((rng.normal(0, 0.5, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32))
    out = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
    return Net(langs, table, recurrent, out, np.zeros((len(langs), 1), np.float32))


def _states(table: np.ndarray, recurrent: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch) after each byte of steps (time, batch)."""
    hid, n = recurrent.shape[1], steps.shape[1]
    states = np.empty((len(steps), hid, n), np.float32)
    h, pre, rec, cand = np.zeros((hid, n), np.float32), np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32), np.empty((hid, n), np.float32)
    gates = np.empty((2 * hid, n), np.float32)
    for t, x in enumerate(steps):
        if keep is not None:
            pre, rec, cand, gates = np.empty_like(pre), np.empty_like(rec), np.empty_like(cand), np.empty_like(gates)
        np.take(table, x, axis=1, out=pre, mode="clip")
        np.matmul(recurrent, h, out=rec)
        np.add(pre[: 2 * hid], rec[: 2 * hid], out=gates)
        if keep is not None:
            raw = gates.copy()
        np.clip(gates, 0, 1, out=gates)
        np.multiply(gates[hid:], rec[2 * hid :], out=cand)
        np.add(cand, pre[2 * hid :], out=cand)
        if keep is not None:
            keep.append((h, raw, gates, rec[2 * hid :], cand.copy()))
        np.clip(cand, -1, 1, out=cand)
        new = states[t]
        np.subtract(cand, h, out=new)
        np.multiply(new, gates[:hid], out=new)
        np.add(new, h, out=new)
        h = new
    return states


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def position_probabilities(net: Net, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Probabilities (languages, time x batch) of the language at each byte of steps (time, batch)."""
    caches: list[list | None] = [[], []] if keep is not None else [None, None]
    ahead = _states(net.table[0], net.recurrent[0], steps, caches[0])
    back = _states(net.table[1], net.recurrent[1], steps[::-1], caches[1])[::-1]
    both = np.concatenate([ahead, back], axis=1).transpose(1, 0, 2).reshape(2 * ahead.shape[1], -1)
    if keep is not None:
        keep += [caches, both]
    return _softmax(net.out @ both + net.bias)


def _through_time(recurrent: np.ndarray, steps: np.ndarray, cache: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's table and recurrent weights, given those of its states (time, hidden, batch)."""
    hid = recurrent.shape[1]
    d_rec = np.zeros_like(recurrent)
    d_pre = np.empty((len(steps), 3 * hid, steps.shape[1]), np.float32)
    dh = np.zeros_like(grad[0])
    for t in range(len(steps) - 1, -1, -1):
        h, raw, gates, un, cand = cache[t]
        dh = dh + grad[t]
        z, r, n = gates[:hid], gates[hid:], np.clip(cand, -1, 1)
        d_cand = dh * z * (np.abs(cand) < 1)
        d_gates = np.concatenate([dh * (n - h), d_cand * un]) * ((raw > 0) & (raw < 1))
        back = np.concatenate([d_gates, d_cand * r])
        d_pre[t] = np.concatenate([d_gates, d_cand])
        d_rec += back @ h.T
        dh = dh * (1 - z) + recurrent.T @ back
    flat, x = d_pre.transpose(1, 0, 2).reshape(3 * hid, -1), steps.ravel()
    return np.stack([np.bincount(x, weights=row, minlength=256) for row in flat]).astype(np.float32), d_rec


def gradients(net: Net, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the letters' bytes, and its gradients in the order of parameters()."""
    kept: list = []
    p = position_probabilities(net, steps, kept)
    caches, both = kept
    weight = _LETTER[steps].astype(np.float32).ravel()
    weight /= max(1.0, weight.sum())
    target = np.tile(labels, len(steps))
    at = np.arange(len(target))
    loss = float(-(np.log(p[target, at] + 1e-12) * weight).sum())
    p[target, at] -= 1
    p *= weight
    d_both = (net.out.T @ p).reshape(both.shape[0], len(steps), -1).transpose(1, 0, 2)
    hid = both.shape[0] // 2
    one = _through_time(net.recurrent[0], steps, caches[0], d_both[:, :hid])
    two = _through_time(net.recurrent[1], steps[::-1], caches[1], d_both[::-1, hid:])
    return loss, [one[0], two[0], one[1], two[1], p @ both.T, p.sum(axis=1, keepdims=True)]


def train(segments: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 7) -> Net:
    """Adam on random batches of segments (n, SEGMENT), the same number from each language on average."""
    net, rng = new_net(langs, seed=seed), np.random.default_rng(seed)
    groups = [np.flatnonzero(labels == i) for i in range(len(langs))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(langs), TRAIN_BATCH)
        rows = np.array([rng.choice(groups[c]) for c in chosen])
        _, grads = gradients(net, segments[rows].T.astype(np.intp), labels[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps) * min(1.0, 1.0 / (norm + 1e-9))
        for p, g, (m, v) in zip(net.parameters(), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments (n, SEGMENT) of all texts, padded with zeros, and the text each belongs to."""
    sizes = np.diff(offsets)
    count = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][owner] + (np.arange(len(owner)) - first) * SEGMENT
    left = offsets[1:][owner] - starts
    within = np.arange(SEGMENT)
    out = data[np.minimum(starts[:, None] + within, max(0, len(data) - 1))] if len(data) else np.zeros((0, SEGMENT), np.uint8)
    short = left < SEGMENT
    out[short] = np.where(within < left[short, None], out[short], 0)
    return out, owner


def predict(net: Net, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the pooled probabilities (texts, languages), and per language the share of its letters' bytes labelled so."""
    n, total = len(offsets) - 1, len(net.langs)
    pooled, votes, letters = np.zeros((n, total)), np.zeros((n, total)), np.zeros(n)
    segments, owner = _cut(data, offsets)
    for i in range(0, len(segments), BATCH):
        part, own = segments[i : i + BATCH], owner[i : i + BATCH]
        p = position_probabilities(net, np.ascontiguousarray(part.T).astype(np.intp))
        weight = np.ascontiguousarray(_LETTER[part].T)
        best = p.argmax(axis=0).reshape(SEGMENT, -1)
        letters += np.bincount(own, weights=weight.sum(axis=0), minlength=n)
        for c in range(total):
            pooled[:, c] += np.bincount(own, weights=np.einsum("tb,tb->b", p[c].reshape(SEGMENT, -1), weight.astype(np.float32)), minlength=n)
            votes[:, c] += np.bincount(own, weights=((best == c) & weight).sum(axis=0), minlength=n)
    letters = np.maximum(letters, 1)[:, None]
    return pooled / letters, votes / letters


def held_out(id_col: str):
    """True for the documents that are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """lang, segment: at most per_lang x SEGMENTS_PER_DOC rows of each language.

    Documents are chosen by the hash of their id among those with a letter. Of a frequent language only hashes below a bound
    are looked at, EXTRA times as many documents as are taken, so that no task gets all of them. Only numbers are shuffled;
    then the texts are looked up, one for each id. Documents without an id are not learned from.
    """
    key = F.col(id_col).cast("long").alias("k_id")
    readable = F.col(text_col).rlike(r"\p{L}")
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col) & readable).select(key, F.col(lang_col).alias("lang"))
    bound = F.lit(-(2.0**63)) + F.lit(2.0**64) * (EXTRA * per_lang) / F.col("n")
    known = known.join(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang").where(F.xxhash64("k_id").cast("double") < bound)
    chosen = first_rows(known, ["lang"], [F.xxhash64("k_id"), F.col("k_id")], per_lang).distinct()
    rows = docs.where(readable).select(key, F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    rows = first_rows(rows.join(F.broadcast(chosen), ["k_id", "lang"]), ["k_id", "lang"], [F.xxhash64("text")])
    size = F.length("text")
    step = F.greatest(F.lit(SEGMENT), F.ceil(size / SEGMENTS_PER_DOC)).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), size - 1), step))
    return rows.select("lang", "text", at.alias("at")).select("lang", F.substring("text", F.col("at") + 1, F.lit(SEGMENT)).alias("segment"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """The trained net; None if no document can be learned from."""
    rows = training_segments(docs, id_col, text_col, lang_col).toArrow()
    if not rows.num_rows:
        return None
    pairs = sorted(zip(rows.column("lang").to_pylist(), rows.column("segment").to_pylist()))
    langs = sorted({a for a, _ in pairs})
    number = {a: i for i, a in enumerate(langs)}
    segments = np.stack([np.frombuffer(b.ljust(SEGMENT, b"\0"), np.uint8) for _, b in pairs])
    return train(segments, np.array([number[a] for a, _ in pairs]), langs)


def identify(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score and agreement.

    A null text, or one without letters, is `und` with score 0; so is every text if there was nothing to learn from.
    Equal texts have equal predictions. Columns of docs with these names are replaced. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    fields = [("lang_pred", pa.string()), ("score", pa.float64()), ("agreement", pa.float64())]

    @F.pandas_udf("lang_pred string, score double, agreement double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            offsets, data = strings(pa.array(batch, type=pa.large_string()))
            begin, stop = offsets[0], offsets[-1]
            pooled, votes = predict(net, data[begin:stop], offsets - begin)
            best = pooled.argmax(axis=1) if len(pooled) else np.zeros(0, int)
            at = np.arange(len(best))
            yield pd.DataFrame({"lang_pred": [net.langs[b] for b in best], "score": np.clip(pooled[at, best], 0, 1), "agreement": np.clip(votes[at, best], 0, 1)})

    text = F.col(text_col)
    rows = docs.drop(*[n for n, _ in fields])
    [own] = unused(rows, "_label")
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("agreement"))
    if net is None:
        rows = rows.withColumn(own, nothing)
    else:
        readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        rows = rows.withColumn(own, label(F.when(readable, text)))
        rows = rows.withColumn(own, F.when(readable, F.col(own)).otherwise(nothing))
    return rows.select(*[c for c in rows.columns if c != own], F.col(f"{own}.*"))
