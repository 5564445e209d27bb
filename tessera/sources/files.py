"""JSON lines with damaged lines counted, evaluation corpora, HTML pages, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import clean_page, html_text

BAD = "_bad_line"


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON-lines files or folders with the text of damaged lines in _bad_line; blank lines
    are no rows. Read as text, so one damaged line never fails a file."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.select(parsed.alias("row")).select("row.*")


def count_lines(rows: DataFrame) -> DataFrame:
    """records, malformed of what read_json_lines gave."""
    return rows.agg(F.count_if(F.col(BAD).isNull()).alias("records"), F.count_if(F.col(BAD).isNotNull()).alias("malformed"))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An evaluation corpus (one JSON document): pages (doc_key, page_number, text) and cases with
    their expected units (case_id, type, question, doc_key, page_number)."""
    schema = (
        "documents array<struct<key: string, fileName: string, pages: array<string>>>, cases array<struct<id: string, type: string, question: string, "
        "docKeys: array<string>, shouldAbstain: boolean, expectedEvidence: array<struct<docKey: string, pages: array<int>>>>>"
    )
    corpus = spark.read.schema(schema).option("multiLine", True).json(path)
    docs = corpus.select(F.explode("documents").alias("d"))
    pages = docs.select(F.col("d.key").alias("doc_key"), F.posexplode("d.pages").alias("page_number", "text")).select("doc_key", (F.col("page_number") + 1).alias("page_number"), clean_page(F.col("text")).alias("text"))
    cases = corpus.select(F.explode("cases").alias("c"))
    units = cases.select(F.col("c.id").alias("case_id"), F.col("c.type").alias("type"), F.col("c.question").alias("question"), F.col("c.shouldAbstain").alias("should_abstain"), F.explode_outer("c.expectedEvidence").alias("e"))
    units = units.select("case_id", "type", "question", "should_abstain", F.col("e.docKey").alias("doc_key"), F.explode_outer("e.pages").alias("page_number"))
    return pages, units


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text: the visible text of HTML pages."""
    return pages.select(F.col(id_col).alias("page_id"), html_text(F.col(html_col)).alias("text"))


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """An index as Parquet in folders by a hash of the document, so that replacing documents
    rewrites the folders they lie in and no others."""
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
