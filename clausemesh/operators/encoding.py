"""Encoding texts with a plug-in: each different text once, in micro-batches, and back to all of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cache_key
from .retrieval import attach_encodings, missing_encodings

Encoder = Callable[[list[str]], list[list[float]]]
BATCH = 32


class DummyWrite(RuntimeError):
    """Vectors of a dummy encoder must not be stored."""


def encode_missing(texts: DataFrame, stored: DataFrame, encoder: Encoder, model: Column, batch: int = BATCH) -> DataFrame:
    """cache_key, vector, call: every different text that has no stored vector, `batch` of them in one call of the encoder.
    A task makes its calls one after the other; `call` names the call a vector came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, calls = TaskContext.get().partitionId(), 0
        keys, waiting = [], []

        def flush() -> pa.RecordBatch:
            vectors = encoder(waiting)
            if len(vectors) != len(waiting):
                raise ValueError(f"the encoder gave {len(vectors)} vectors for {len(waiting)} texts")
            names = pa.array([f"{task}:{calls}"] * len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64())), names], names=["cache_key", "vector", "call"])

        for part in batches:
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                keys.append(key)
                waiting.append(text)
                if len(keys) == batch:
                    yield flush()
                    calls += 1
                    keys.clear()
                    waiting.clear()
        if keys:
            yield flush()

    wanted = missing_encodings(texts.where(F.col("text").isNotNull()), stored, model)
    return wanted.select("cache_key", "text").mapInArrow(run, "cache_key string, vector array<double>, call string")


def encode_rows(texts: DataFrame, stored: DataFrame, new: DataFrame, model: Column) -> DataFrame:
    """Every row of texts with its vector, stored or new; null texts have none."""
    return attach_encodings(texts, stored.select("cache_key", "vector").unionByName(new.select("cache_key", "vector")), model)


def store_encodings(new: DataFrame, path: str, dummy: bool) -> None:
    """Append new vectors to the stored ones; refused for a dummy encoder, whose vectors mean nothing."""
    if dummy:
        raise DummyWrite("vectors of a dummy encoder are not stored")
    new.select("cache_key", "vector").write.mode("append").parquet(path)


__all__ = ["BATCH", "DummyWrite", "Encoder", "cache_key", "encode_missing", "encode_rows", "store_encodings"]
