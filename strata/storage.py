"""Reliable checkpoints for iterations: rows in the folder that driver and executors share. Rows dealt evenly to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary folder serves only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/strata-checkpoints")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A path for a new table in the shared folder."""
    return f"{_shared(spark)}/table-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows from a checkpoint in spark.checkpoint.dir, so that neither plans grow nor lost executors cost what led here."""
    _shared(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, path: str | None = None) -> DataFrame:
    """The frame's rows from a table in the shared folder, for rounds that join what earlier rounds gave with itself.

    A checkpoint is taken for as large as its plan's joins can make it, a product; from round to round its digits double until
    planning takes longer than the work. The size of a table is that of its files.
    """
    path = path or new_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def partitioned(frame: DataFrame, *keys: str, path: str | None = None) -> DataFrame:
    """The frame's rows from a table in the shared folder that is partitioned by keys, so that a filter on them reads its part alone."""
    path = path or new_folder(frame.sparkSession)
    frame.write.partitionBy(*keys).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that later rounds have replaced."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of frames that are gone, which it does after the driver's garbage collection."""
    spark._jvm.System.gc()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys to ``spark.sql.shuffle.partitions`` tasks. For narrow rows that cost much each: a small table is one file and so one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
