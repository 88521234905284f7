"""Session settings and the shared-folder rule used by the whole package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "clausemesh", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package relies on.

    Cluster-wide choices (master, memory, executors, spark.checkpoint.dir) stay with
    whoever submits the job; only SQL semantics are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that jobs may start in any folder."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="clausemesh-"), "clausemesh_package")
        with zipfile.ZipFile(f"{base}.zip", "w") as out:
            for folder, _, files in os.walk(home):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(home)))
        spark.sparkContext.addPyFile(f"{base}.zip")
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir.

    Only where the cluster names none (local tests) a temporary folder is made and
    remembered for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "clausemesh.shared.dir", None
    )
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("clausemesh.shared.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a table written once."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to a table in the shared folder and read from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see one fixed set of rows even if executors die."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
