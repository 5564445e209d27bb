"""A vector index as a table in buckets of its key: paged scroll, batched replacement, deletion.

Rows are dealt to folders by a hash of their key. A change rewrites the folders that hold its keys and
leaves the others as they are, so its cost follows the change and not the index.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import kept

BUCKET = "bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new index of rows; buckets should be so many that one is a few hundred MB."""
    dealt = rows.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(BUCKET)
    dealt.write.partitionBy(BUCKET).mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _rewrite(spark: SparkSession, path: str, key: str, buckets: int, changes: DataFrame, merge) -> list[int]:
    """Puts merge(rows of the buckets that changes touch) in the place of those buckets; gives their numbers."""
    changed = kept(changes.withColumn(BUCKET, bucket_of(F.col(key), buckets)))
    touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())  # at most buckets numbers
    if not touched:
        return []
    whole = spark.read.parquet(path)
    # kept first: the folders that are read are those that are written
    after = kept(merge(whole.where(F.col(BUCKET).isin(touched)), changed).select(whole.columns))
    after.repartition(BUCKET).write.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).mode("overwrite").parquet(path)
    return touched


def replace_vectors(spark: SparkSession, path: str, key: str, vector: str, buckets: int, updates: DataFrame) -> list[int]:
    """New vectors for rows that are there; other columns stay, unknown keys are left out. Gives the buckets
    that were written. updates: one row a key, with key and vector."""

    def merge(held: DataFrame, changed: DataFrame) -> DataFrame:
        new = changed.select(F.col(key).alias("new_key"), F.col(vector).alias("new_vector"))
        met = held.join(new, held[key] == F.col("new_key"), "left")
        return met.withColumn(vector, F.when(F.col("new_key").isNotNull(), F.col("new_vector")).otherwise(F.col(vector)))

    known = updates.join(read_index(spark, path).select(key), key, "left_semi")
    return _rewrite(spark, path, key, buckets, known, merge)


def upsert(spark: SparkSession, path: str, key: str, buckets: int, rows: DataFrame) -> list[int]:
    """Whole rows in the place of those of their keys, or added. Gives the buckets that were written."""
    return _rewrite(spark, path, key, buckets, rows, lambda held, changed: held.join(changed.select(key), key, "left_anti").unionByName(changed))


def scroll(index: DataFrame, key: str, after: object = None, limit: int = 256) -> DataFrame:
    """The next page: the limit rows of the smallest keys beyond after, in order. The last key of a page is
    the after of the next."""
    rows = index if after is None else index.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def each_page(index: DataFrame, key: str, limit: int = 256) -> Iterator[list]:
    """All pages one after another, for a reader that takes a page at a time."""
    after = None
    while page := scroll(index, key, after, limit).collect():
        yield page
        after = page[-1][key]


def pages(index: DataFrame, key: str, limit: int = 256) -> DataFrame:
    """The rows with page, from 0, and place in it: what a scroll of the whole gives, in one job.

    Keys are dealt by range, numbered inside each range and moved on by the sizes of the ranges before.
    """
    part, place = "range_no", "place"
    dealt = kept(index.repartitionByRange(F.col(key)).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")  # a row a range
    turn = F.row_number().over(Window.partitionBy(part).orderBy(key)) - 1
    rows = dealt.withColumn(place, turn).join(F.broadcast(before), part).withColumn(place, F.col(place) + F.col("before"))
    return rows.withColumn("page", F.floor(F.col(place) / limit)).withColumn(place, F.col(place) % limit).drop(part, "before")
