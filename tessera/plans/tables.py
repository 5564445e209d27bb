"""How the driver tables stand for the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import fixed_windows
from tessera.operators.index import few_rows, run_holders
from tessera.sources.scratch import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs below this size are dealt out before text work; larger ones have row groups enough.
SMALL_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Small inputs over all cores: a file of one row group is one task however it is split, and
    text work on it would run alone. Larger inputs stay as they are read, without a shuffle."""
    spark = rows.sparkSession
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_BYTES else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_windows(documents(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id: documents that hold a passage (of seven words or more) verbatim.

    Found by an index of five-word runs: all words of a passage but the first and the last stand whole in any
    document that holds it; the text is compared only for those documents.
    """
    passages = questions(spark, sf_dir).withColumn("words", F.split("query", r"\s+")).where(F.size("words") >= 7)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    small = few_rows(passages)
    near = kept(run_holders(docs, passages.select("query_id", "words"), small is F.broadcast))
    held = docs.join(few_rows(near)(near), "doc_id").join(small(passages.select("query_id", "query")), "query_id")
    return held.where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id").distinct()


HOLDERS_SQL = r"""
    SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)
    WHERE len(regexp_split_to_array(b.text, '\s+')) >= 7
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls: value as latency in ms, its tenfold as characters, props.k as route."""
    events = table(spark, sf_dir, "events")
    route = F.concat(F.lit("route"), F.get_json_object("props", "$.k").cast("int") % 5)
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 1, "skipped").otherwise("ok")
    tokens = F.ceil(F.floor("value") * 10 / 4)
    return events.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("operation"), route.alias("route"), status.alias("status"), F.col("value").alias("latency_ms"),
        tokens.alias("tokens"), (tokens / 1e6 * 2.5).alias("cost"), F.when(F.col("value") <= 50, "pass").otherwise("breach").alias("slo"),
    )


CALLS_SQL = """
    SELECT event_id, ts, user_id, event_type AS operation, 'route' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS route,
           CASE WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'skipped' ELSE 'ok' END AS status, value AS latency_ms,
           CAST(ceil(floor(value) * 10 / 4) AS BIGINT) AS tokens, ceil(floor(value) * 10 / 4) / 1e6 * 2.5 AS cost,
           CASE WHEN value <= 50 THEN 'pass' ELSE 'breach' END AS slo
    FROM events
"""
