"""Helpers of the searches: queries in blocks of bounded size, packed tables, and the best k of every query.

A search reads a table of packed segments (arrays of a bounded number of rows) once for each block of queries. A block is
bounded and goes to the tasks as a broadcast value, which is dropped when its pass is written; no pair of a query and a
row leaves a task but those among the task's best k. No row is dealt by a key, so that no key can be hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path

#: Kept entries of a task before it cuts them to the best k.
HELD = 1 << 20
Batches = Iterator[pa.RecordBatch]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to a table in the shared folder and read from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_blocks(queries: DataFrame, size: int, weight: str | None = None) -> Iterator[pa.Table]:
    """The queries (different rows) in blocks of about `size` rows, or of about that sum of the column `weight`, by the
    hash of the row. They should be stored: each block is a pass over them."""
    total = queries.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 0
    blocks = max(1, -(-int(total) // size))
    key = F.xxhash64(*[F.col(c) for c in queries.columns])
    for block in range(blocks):
        found = (queries if blocks == 1 else queries.where(F.pmod(key, F.lit(blocks)) == block)).toArrow()
        if found.num_rows:
            yield found.combine_chunks()


def passes(index: DataFrame, blocks: Iterator, task: Callable[[object], Callable[[Batches], Batches]], schema: str, name: str) -> DataFrame:
    """One pass over the index for each block: mapInArrow of task(block), which gets the block by broadcast."""
    spark = index.sparkSession
    path = fresh_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Batches, shared=shared) -> Batches:
            yield from task(shared.value)(batches)

        index.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def column(batch: pa.RecordBatch, name: str, row: int = 0) -> np.ndarray:
    """The array of one row of a list column."""
    return batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)


def lists(flat: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    """A list column of these lengths from its flat values."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def matrix(vectors: pa.Array, size: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column without nulls; a vector shorter than `size` goes on with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    out = np.zeros((len(lengths), size), dtype)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


class Best:
    """The k best (score, id) of n queries: higher scores first, ties by smaller id. Equal entries of a query count once
    if `distinct`. floor is each query's k-th best score so far: a row below it cannot enter, a row equal to it can."""

    def __init__(self, k: int, n: int, lowest: int | float, distinct: bool = True):
        self.k, self.distinct = k, distinct
        self.floor = np.full(n, lowest)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.cut_at = 0

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if len(query):
            self.kept.append((query, score, name))
            self.size += len(query)
            if self.size > max(HELD, 2 * self.cut_at):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of the entries that remain, in order."""
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, self.floor.dtype), np.zeros(0, np.int64)
        q, s, i = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        if self.distinct:
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
            q, s, i = q[new], s[new], i[new]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.floor[q[last]] = s[last]
        q, s, i = (c[nth < self.k] for c in (q, s, i))
        self.kept, self.size, self.cut_at = [(q, s, i)], len(q), len(q)
        return q, s, i
