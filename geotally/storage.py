"""Shared storage of a run: checkpoints and scratch files."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from geotally import lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a cluster that would be a
    folder of the driver alone, so it raises.
    """
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="geotally-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


_FOLDERS: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """The folder of this application's scratch files in the shared one; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(named)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[app] = named
    return _FOLDERS[app]


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path for files of this run in the shared folder."""
    return f"{_own_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    after = df.checkpoint(eager=True)
    lineage.remember(df, after)
    return after


def written(df: DataFrame, kind: str) -> DataFrame:
    """The same rows written as a table in the shared folder, for several readers: worked out once (a checkpoint works out its last
    stage twice), and a reader gets only the columns that it asks for."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    after = df.sparkSession.read.schema(df.schema).parquet(path)
    lineage.remember(df, after)
    return after


def release(spark: SparkSession) -> None:
    """Let go of finished steps now: shuffle files stay until the driver's garbage is collected, which a loop of small
    steps on large tables may put off for long."""
    gc.collect()
    spark._jvm.System.gc()
