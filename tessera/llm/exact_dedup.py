"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

The text itself is the second grouping key after its hash, so equality is decided on bytes while
rows are dealt and compared by hash first. Partial aggregation folds copies before the shuffle: a
text that a third of all rows share leaves each map task as one row.

Defined results: a null text counts as empty; a row with an id stays rather than one without; a
repeated row (same id and text) counts in its group as often as it occurs, and just one of them is
kept; an empty table gives an empty result; columns other than id and text are never read by
duplicate_groups and pass unchanged through exact_dedup, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def duplicate_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep is "min" or "max": which id of a group stays. Members are found again by hash and
    SHA-256 of the byte-exact group, so the texts are shuffled once; a join key that many rows
    share is split by adaptive execution, as both sides are plain shuffles. hashed may be any
    function of the text: collisions cost time, never rows.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chosen = F.max("doc_id") if keep == "max" else F.min("doc_id")
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    groups = (
        base.groupBy(hashed(F.col("text")).alias("h"), "text")
        .agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", digest, "keep_id", "group_size")
    )
    rows = base.select("doc_id", hashed(F.col("text")).alias("h"), digest).groupBy("h", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    turn = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("turn")  # one of equal rows is kept
    return rows.join(groups, ["h", "digest"]).select("*", turn).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row for each distinct text, with the columns of docs.

    Of rows that agree in text and id, the one whose other columns hash highest stays.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    missing = F.col(f"`{id_col}`").isNotNull() if keep == "max" else F.col(f"`{id_col}`").isNull()
    order = F.struct(missing.alias("m"), F.col(f"`{id_col}`").alias("i"), (F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0)).alias("o"))
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col], F.col(f"`{text_col}`").isNull().alias("was_null"))
    pick = F.max_by if keep == "max" else F.min_by
    h, of_text, held = (fresh(docs, n) for n in ("content_hash", "content", "row_kept"))
    one = docs.groupBy(content_hash(body).alias(h), body.alias(of_text)).agg(pick(row, order).alias(held))
    text = F.when(~F.col(f"{held}.was_null"), F.col(of_text))
    return one.select(*[(text if c == text_col else F.col(f"{held}.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {
    "op8_exact_dedup": """
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM (
            SELECT doc_id,
                   max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
                   count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents
        )
    """
}
