"""A table that streams append to exactly once.

A batch of a stream writes its rows to a folder of its own, named after the stream and the epoch, and then a commit: one small
file that names both. Readers see the folders that have a commit, and no others. A batch that runs again after its commit is
skipped; one that failed before it is written over. So a crash at any point changes nothing. compact() moves the rows of
all commits so far into one folder, in the same way: the folder first, then one file that stands for all of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMIT = "stream string, epoch long, folder string, replaces array<string>"


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commits(self) -> DataFrame:
        """stream, epoch, folder, replaces."""
        try:
            return self.spark.read.schema(_COMMIT).parquet(os.path.join(self.path, "commits"))
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], _COMMIT)

    def _commit(self, stream: str, epoch: int, folder: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(stream, epoch, folder, replaces)], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(os.path.join(self.path, "commits"))

    def folders(self) -> list[str]:
        """Folders of rows that count: one for each batch since the last compact()."""
        every = self.commits()
        gone = every.select(F.explode("replaces").alias("folder"))
        return sorted({r["folder"] for r in every.join(gone, "folder", "left_anti").select("folder").collect()})

    def append(self, rows: DataFrame, stream: str, epoch: int, before_commit: Callable[[], None] = lambda: None) -> bool:
        """Whether the rows were written; not, if this batch of the stream has been."""
        done = self.commits().where((F.col("stream") == stream) & (F.col("epoch") >= epoch)).limit(1).count()
        if done:
            return False
        folder = f"rows/stream={stream}/epoch={epoch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(self.path, folder))
        before_commit()
        self._commit(stream, epoch, folder, [])
        return True

    def read(self, schema: str | None = None) -> DataFrame:
        """All committed rows; `schema` is needed while there are none."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], schema or "_none int")
        return self.spark.read.parquet(*[os.path.join(self.path, f) for f in folders])

    def compact(self, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Put all committed rows into one folder, after `change` (such as leaving out old versions)."""
        old = self.folders()
        if len(old) < 2:
            return
        epochs = self.commits().where("stream <> ''").groupBy("stream").agg(F.max("epoch").alias("epoch")).collect()
        number = 1 + sum(r["epoch"] + 1 for r in epochs)
        folder = f"rows/whole={number}"
        change(self.read()).write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(self.path, folder))
        self._commit("", number, folder, old)
