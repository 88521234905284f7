"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of an Arrow batch; a batch of long documents has to fit in a Python worker several times over.
BATCH_ROWS = 1000
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed where a column of df already has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def key_id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns k_id, k_h, text. The pair (id, hash of the text) stands for a document: rows that are equal in both
    are the same document to every operator, and a null id comes before all others."""
    return docs.select(
        key_id(id_col).alias("k_id"), F.xxhash64(F.col(text_col)).alias("k_h"), F.col(text_col).alias("text")
    )


def id_of(col: str = "k_id") -> Column:
    """The id that keyed() replaced."""
    return F.when(F.col(col) != NO_ID, F.col(col))


def give_back_memory() -> None:
    """Return what this Python worker has freed to the system, where its C library can. Workers live on between tasks and
    would keep it, beside the full heap of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def all_equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reachable.

    Labels go over the edges as minima, which are combined before each shuffle, and every round also replaces a label
    by its own label, so that long chains halve. A node with very many edges is a skewed join key, which adaptive
    execution splits; no neighbour list is gathered. Each round is cut by a reliable checkpoint.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut_lineage(edges.where("a <> b").select(ways.alias("e")).select("e.*").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("root").alias("low"))
        new = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("step"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = new.join(up, new.step == up.via, "left").select("node", "old", F.least("step", F.coalesce("far", "step")).alias("root"))
        new = cut_lineage(new)
        labels = new.select("node", "root")
        if new.where("root <> old").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components are not closed after {rounds} rounds")
