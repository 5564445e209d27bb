"""Windowed roll-ups, session memory with a time to live, and incremental index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scores import fixed

TTL_SECONDS = 6 * 3600


def windowed_rollup(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and type: events, mean value, users. Late rows beyond the watermark are dropped.

    events (batch or stream): ts (timestamp), event_type, user_id, value.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), fixed(F.avg("value"), 4).alias("mean_value"), F.approx_count_distinct("user_id", 0.01).alias("users"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "events", "mean_value", "users")


def sessions_by_gap(events: DataFrame, ttl_seconds: int = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """Sessions of a batch or a stream: user_id, started, ended, events.

    A session is a user's run of events with gaps below the time to live. A stream gives a session
    out once the watermark has passed its end by that long; rows later than `late` are dropped, and
    state holds one small row for each open session.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window("ts", f"{ttl_seconds} seconds").alias("w"), "user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"))
    return grouped.select("user_id", "started", "ended", "events")


def merge_term_counts(table: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """term, df after a batch of new chunks: the delta is aggregated before it meets the table."""
    from tessera.operators.index import document_frequency

    delta = document_frequency(chunks)
    return delta if table is None else table.unionByName(delta).groupBy("term").agg(F.sum("df").alias("df"))


def follow_term_counts(spark: SparkSession, chunks: DataFrame, path: str, checkpoint: str, compact_every: int = 16):
    """A query that keeps document frequencies of a stream of chunks under path; read them by
    term_counts().

    Each batch writes its own counts in a folder of its number; every compact_every batches the sum
    of all is written beside them. Folders are written whole, so a repeated batch gives the same.
    """

    def step(batch: DataFrame, number: int) -> None:
        merge_term_counts(None, batch).write.mode("overwrite").parquet(f"{path}/kind=delta/batch={number}")
        if number % compact_every == compact_every - 1:
            term_counts(spark, path, number).write.mode("overwrite").parquet(f"{path}/kind=whole/batch={number}")

    return chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(spark: SparkSession, path: str, through: int | None = None) -> DataFrame:
    """term, df after all batches (or those up to one): the last whole sum and the deltas after it."""
    rows = spark.read.schema("term string, df long, kind string, batch long").parquet(path)
    if through is not None:
        rows = rows.where((F.col("batch") < through) | ((F.col("batch") == through) & (F.col("kind") == "delta")))
    last = rows.where("kind = 'whole'").agg(F.max("batch")).first()[0]
    if last is not None:
        rows = rows.where(((F.col("kind") == "whole") & (F.col("batch") == last)) | ((F.col("kind") == "delta") & (F.col("batch") > last)))
    return rows.groupBy("term").agg(F.sum("df").alias("df"))
