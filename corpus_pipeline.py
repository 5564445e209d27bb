"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of documents, for all rows its predecessor kept.

Defined results: null and empty texts are documents like any other until a stage drops them (they
are copies of each other; a text without words has no near copies and loses no words); rows without
id are never near copies, and lose words that a row with an id holds; of repeated rows one stays;
without labels the quality stage keeps all; empty tables give no pieces; further columns pass
unchanged to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import fold, scratch_folder, stored, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import features_of, fit, keep_quality
from tessera.llm.substring_dedup import strip_repeats

LEAST_QUALITY = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    training = fold("doc_id", 4) != 2
    features = stored(features_of(docs.where(training)))
    model = fit(features, table(spark, sf_dir, "labels").where(training))
    return keep_quality(docs, model, LEAST_QUALITY)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the smallest id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest id."""
    return drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document of smaller id holds go; so do documents left without words."""
    return strip_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, with their ids."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can't express the classifier, so the pipeline is tested against its stages' brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
