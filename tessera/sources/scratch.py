"""Intermediate results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither that setting nor a checkpoint folder exists, a local session makes a temporary
    one; on a cluster that is an error, as executors don't share such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and cut from their lineage, in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def filed(rows: DataFrame) -> DataFrame:
    """rows, computed once and written in the shared folder as Parquet: a fraction of a checkpoint's bytes, and the
    rows are worked out once, where a checkpoint counts them first. Neither keeps how rows are dealt."""
    path = scratch_path(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
