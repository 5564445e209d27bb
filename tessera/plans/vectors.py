"""A vector index of the embeddings: its pages, and its rows after vectors are replaced, added and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.plans.tables import table
from tessera.sources.scratch import scratch_path

BUCKETS = 16


def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a scroll over the whole index, 256 rows each."""
    rows = vectors.pages(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 256)
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("held"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def vector_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an index after every twentieth vector was turned around, and rows of every fiftieth added
    under new keys."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    path = scratch_path(spark, "vectors")
    vectors.write_index(rows, path, "vec_id", BUCKETS)
    turned = rows.where("vec_id % 20 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    vectors.replace_vectors(spark, path, "vec_id", "embedding", BUCKETS, turned)
    vectors.upsert(spark, path, "vec_id", BUCKETS, rows.where("vec_id % 50 = 0").withColumn("vec_id", -F.col("vec_id") - 1))
    return vectors.read_index(spark, path).select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("first_value"), F.size("embedding").cast("long").alias("dimensions"))


QUERIES = {f.__name__: f for f in (vector_pages, vector_update)}
ORACLES = {
    "vector_pages": """
        SELECT page, count(*) AS held, min(vec_id) AS first_id, max(vec_id) AS last_id
        FROM (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 256 AS page FROM embeddings) GROUP BY page
    """,
    "vector_update": """
        SELECT vec_id, label, CAST(CASE WHEN vec_id % 20 = 0 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE) AS first_value, len(embedding) AS dimensions FROM embeddings
        UNION ALL SELECT -vec_id - 1, label, CAST(embedding[1] AS DOUBLE), len(embedding) FROM embeddings WHERE vec_id % 50 = 0
    """,
}
