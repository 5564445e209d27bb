"""A versioned table of chunks: an ingest is staged, checked, then made visible by one small write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import replace_documents


class EmptyIngest(ValueError):
    """The pages gave no chunk."""


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the latest committed version, or None before the first."""
    try:
        log = spark.read.schema("version long, folder string").option("recursiveFileLookup", True).json(f"{path}/_versions")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    last = log.orderBy(F.desc("version")).first()
    return spark.read.parquet(f"{path}/{last['folder']}") if last else None


def ingest(spark: SparkSession, chunks: DataFrame, path: str) -> int:
    """Replaces the chunks' documents in the store; returns the new version.

    Rows are written to a folder of their own; a version line is added only once they are complete
    and not empty, so a failed ingest leaves the store as it was. Each version has a folder that is
    made only if it isn't there: of two ingests at once, the later one fails and may be run again.
    """
    before = current(spark, path)
    if chunks.isEmpty():
        raise EmptyIngest("no chunks to ingest")
    rows = chunks if before is None else replace_documents(before, chunks)
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    version = 0
    if before is not None:
        version = spark.read.schema("version long, folder string").option("recursiveFileLookup", True).json(f"{path}/_versions").agg(F.max("version")).first()[0] + 1
    line = spark.createDataFrame([(version, folder)], "version long, folder string")
    line.coalesce(1).write.mode("errorifexists").json(f"{path}/_versions/v{version}")
    return version
