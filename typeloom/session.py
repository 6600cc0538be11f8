"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording where in Python each column expression was made costs more than making it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The JVM never compiles methods above 8,000 bytes; Spark then does better without fusing the stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "typeloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library is written for; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="typeloom-ship-")
    archive = shutil.make_archive(
        os.path.join(folder, "typeloom"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="typeloom-")
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing.

    The files go when the application ends.
    """
    path = fresh_path(df.sparkSession, name)
    return _stored_at(df, path)


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`stored` for tables that only the block reads: their files go when it ends.

    What outlives the block is stored itself, by :func:`stored` or the ``scratch`` of a block around it.
    """
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(fresh_path(spark, name))
        return _stored_at(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df):
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
