"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protobuf message; its pieces, scores and normaliser settings are read here from the wire format and
built anew: the precompiled character map, removal of extra spaces, the metaspace marker and the dummy prefix as
normalisers; the pieces with their scores as a unigram model, or, for a model of pair merges, with merges ordered by the
scores of the pieces they make; characters outside the vocabulary as bytes. Batches are encoded by the library's
threads. No piece may hold the marker behind another character; words can then be cut before the marker without any
effect on the result, which lets the backend reuse words it has seen.

Parity with the original library, and that decoding gives the text back, are verified on the ids of every whole text.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, small_batches, unused

#: Folder of public vocabularies; the model is sent to executors from the driver's copy.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
SEEN_WORDS = 200_000
WORDS_AT_ONCE = 256


# --- the model file ------------------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not expected")
        yield number, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    character_map: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_spaces: bool = False


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            model.pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind, model.byte_fallback, model.suffix_spaces = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.character_map = own.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(own.get(i, 1)) for i in (3, 4, 5))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece; those of the best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    out = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            out += [(-score, ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
    return [(a, b) for *_, a, b in sorted(out)]


def backend(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and pair-merge models are supported")
    if not model.escape_spaces or model.suffix_spaces or any(k == USER_DEFINED for *_, k in model.pieces):
        raise ValueError("models with own symbols, suffix markers or bare spaces are not supported")
    if any(MARK in p.lstrip(MARK) for p, *_ in model.pieces):
        raise ValueError("a piece holds the marker behind another character")
    unknown = next((i for i, (*_, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        vocabulary = {p: i for i, (p, *_) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
    out.normalizer = normalizers.Sequence(steps)
    out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] * model.dummy_prefix
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


# --- encoding, with its check --------------------------------------------------------------------


class Codec:
    """Encoder, decoder and check of one model file; made once in a worker.

    Where the normaliser only marks spaces, a text is encoded by its words: each distinct word goes once through the
    backend, in batches, and is remembered (up to SEEN_WORDS, then all but those of the texts at hand are forgotten). The ids
    of a text are those of its words one after the other; these are decoded, and compared with those of the original
    library, for each whole text.
    """

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = parse_model(data)
        self.own = backend(self.model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = not self.model.character_map and not self.model.remove_extra_spaces and self.model.dummy_prefix
        self.marked = np.array([p.startswith(MARK) for p, *_ in self.model.pieces])
        self.marks = np.array([p.strip(MARK) == "" for p, *_ in self.model.pieces])
        self.known: dict[str, bytes] = {}
        #: A single space at the end of a text, which words() gives as an empty word, is a marker with nothing behind it.
        a, with_space = self.encode(["a", "a "])
        self.last_space = np.array(with_space[len(a) :], np.int32).tobytes()
        #: What a piece decodes to, as bytes.
        plain = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in self.model.pieces]
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_size = np.array([len(p) for p in plain])
        self.plain_at = np.cumsum(self.plain_size) - self.plain_size
        #: Words whose rows fail a check whatever their ids give.
        self.lossy: set[str] = set()
        self.unequal: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.own.decode_batch(ids, skip_special_tokens=False)

    @staticmethod
    def words(text: str) -> list[str]:
        """The runs of spaces and the other characters behind them, without the first space; a text begins with one more."""
        if not text:
            return []
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(" *[^ ]+| +", f" {text}")]

    def _learn(self, new: set[str]) -> None:
        """Encode new words, many in one text; a text that does not fall into its words is encoded word by word."""
        blank = [[w] for w in new if w[0] == " " and not w.strip(" ")]  # these would melt into the next word
        words = [w for w in new if w[0] != " " or w.strip(" ")] if blank else list(new)
        groups = blank + [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for group, i in zip(groups, self.encode([" ".join(g) for g in groups])):
            flat = np.array(i, np.int32)
            # a word begins at a piece with the marker in front, unless just markers come before
            begins = np.flatnonzero(self.marked[flat] & ~np.append(False, self.marks[flat[:-1]]))
            if len(begins) == len(group):
                ends, flat = [*(begins[1:] * 4).tolist(), 4 * len(flat)], flat.tobytes()
                self.known.update(zip(group, map(flat.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self.known.update((w, np.array(x, np.int32).tobytes()) for w, x in zip(group, self.encode(group)))

    def _gives(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it; the backend decides unless the bytes of the pieces are those of the text."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = self.plain_size[flat]
        ends = np.cumsum(size)
        at = np.repeat(self.plain_at[flat] - ends + size, size)
        got = self.plain[at + np.arange(len(at))].tobytes()
        wanted = [(b" " if len(i) else b"") + t.encode() for i, t in zip(ids, texts)]
        if got == b"".join(wanted) and [len(w) for w in wanted] == self._sizes(ids, ends):
            return [True] * len(texts)
        cuts = np.cumsum([0, *self._sizes(ids, ends)]).tolist()
        return [got[x:y] == w or self.decode([i.tolist()])[0] == t for x, y, w, i, t in zip(cuts, cuts[1:], wanted, ids, texts)]

    @staticmethod
    def _sizes(ids: list[np.ndarray], ends: np.ndarray) -> list[int]:
        """Bytes that the ids of each text decode to; ends: the bytes up to each id of all texts."""
        return np.diff(np.append(0, ends)[np.cumsum([0, *map(len, ids)])]).tolist()

    def run(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """For each text its ids, whether decoding gives it back, and whether the original library gives these ids."""
        if not self.by_word:
            ids = self.encode(texts)
            checks = zip(ids, self.decode(ids), texts, self.original.encode(texts, num_threads=1))
            return [(np.array(i, np.int32), back == t, i == o) for i, back, t, o in checks]
        cut = [self.words(t) for t in texts]
        every = set().union(*cut) - {""}
        new = every - self.known.keys()
        if len(self.known) + len(new) > SEEN_WORDS:
            self.known = {w: self.known[w] for w in every - new}
        if new:
            self._learn(new)
        known = self.known.__getitem__
        glued = [b"".join(map(known, ws)) if not ws or ws[-1] else b"".join(map(known, ws[:-1])) + self.last_space for ws in cut]
        ids = [np.frombuffer(g, np.int32) for g in glued]
        good = lambda bad, ws: not bad or bad.isdisjoint(ws)
        checks = zip(ids, glued, self._gives(ids, texts), cut, self.original.encode(texts, num_threads=1))
        return [(i, back and good(self.lossy, ws), array("i", theirs).tobytes() == own and good(self.unequal, ws)) for i, own, back, ws, theirs in checks]


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _codecs:
        _codecs[name] = Codec(SparkFiles.get(name))
    return _codecs[name]


def _pieces(texts: list[str | None], limit: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about `limit` characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", model: str = MODEL,
    ids: str = "token_ids", n_tokens: str = "n_tokens", round_trip: str = "round_trip", parity: str = "parity",
) -> DataFrame:
    """All rows and columns of docs, with the ids of each whole text, their number, whether decoding the ids gives the
    text back, and whether the original library gives the same ids.

    A null text has null ids, 0 tokens, and null checks; an empty text has no ids. Equal rows get equal results; an
    empty table stays empty. New columns get a trailing underscore where docs has their name.
    """
    small_batches(spark)
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)
    ids, n_tokens, round_trip, parity, coded = unused(docs, ids, n_tokens, round_trip, parity, "_coded")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        # as many threads as the task has cores: more of them would spin while other tasks want the cores
        os.environ.setdefault("RAYON_NUM_THREADS", str(TaskContext.get().cpus()))
        own = codec(name)
        for batch in batches:
            rows = []
            for part in _pieces(batch.tolist()):
                found = own.run([t or "" for t in part])
                rows += [(None, 0, None, None) if t is None else (i, len(i), back, same) for t, (i, back, same) in zip(part, found)]
            yield pd.DataFrame(rows, columns=["ids", "n", "back", "same"])
        own.known.clear()
        give_back_memory()

    encoded = F.pandas_udf(run, "ids array<int>, n long, back boolean, same boolean")
    rows = docs.withColumn(coded, encoded(F.col(text_col)))
    return rows.select(*docs.columns, F.col(coded)["ids"].alias(ids), F.col(coded)["n"].alias(n_tokens), F.col(coded)["back"].alias(round_trip), F.col(coded)["same"].alias(parity))


def decode_documents(spark: SparkSession, coded: DataFrame, ids: str = "token_ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    small_batches(spark)
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = codec(name).decode([[] if x is None else [int(i) for i in x] for x in batch])
            yield pd.Series([None if x is None else t for x, t in zip(batch, texts)], dtype=object)

    [out] = unused(coded, out)
    return coded.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))
