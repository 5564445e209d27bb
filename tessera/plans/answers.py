"""Answers of conversations, checked against the turns before them.

An assistant's turn is an answer; the other turns of its conversation are its sources, ranked from 1
in order, each a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import sql
from tessera.operators import verify
from tessera.plans.tables import table


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "text")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = table(spark, sf_dir, "conversations").where("role <> 'assistant'")
    ranked = others.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), F.col("turn").alias("doc_id"), "text")
    return answers(spark, sf_dir).select("answer_id", "conv_id").join(ranked, "conv_id").drop("conv_id")


def claim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.claims(answers(spark, sf_dir)).select("answer_id", F.col("claim_index").cast("long").alias("claim_index"), "claim")


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.check_claims(verify.claims(answers(spark, sf_dir)), citations(spark, sf_dir))


def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.answer_verdicts(answers(spark, sf_dir), claim_support(spark, sf_dir), citations(spark, sf_dir))


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.grounded_answers(verify.claims(answers(spark, sf_dir)), claim_support(spark, sf_dir))


QUERIES = {"claims": claim_query, "claim_support": claim_support, "answer_verdicts": answer_verdicts, "grounded_answers": grounded_answers}

_PIECES = r"regexp_split_to_array(regexp_replace(line, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\x01|[;；]+')"
ORACLES = {
    "claims": rf"""
        SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY line_no, piece_no) - 1 AS claim_index, claim FROM (
            SELECT answer_id, line_no, piece_no, {sql.strip(r"regexp_replace(regexp_replace(regexp_replace(piece, '[ \t]{2,}', ' ', 'g'), '[\s.!?。！？]+\z', ''), '^\s*(?:[-*+]|\d+[.)])\s+', '')")} AS claim FROM (
                SELECT answer_id, line_no, generate_subscripts({_PIECES}, 1) AS piece_no, unnest({_PIECES}) AS piece FROM (
                    SELECT conv_id * 1000 + turn AS answer_id, generate_subscripts(regexp_split_to_array(text, '\n+'), 1) AS line_no, unnest(regexp_split_to_array(text, '\n+')) AS line
                    FROM conversations WHERE role = 'assistant'
                ) WHERE NOT regexp_matches(line, '^\s*#{{1,6}}\s+\S') AND NOT (regexp_matches(line, '[:：]\s*\z') AND length(line) <= 60)
            )
        ) WHERE len({sql.terms("claim")}) > 0
    """,
}
