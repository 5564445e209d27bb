"""Summaries of what a retrieval found: evidence, sources, traces, alignment, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import fixed
from tessera.functions.text import excerpt, normalize_whitespace, term_set, terms

PREVIEW = 120


def evidence_summary(results: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, retrieved, usable, least, most, mean (of scores, null without any), documents,
    covered, missing (ids joined by commas).

    results: query_id, doc_id, score, usable. selected: query_id, doc_id.
    """
    sums = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_if("usable").alias("usable"), fixed(F.min("score")).alias("least"), fixed(F.max("score")).alias("most"), fixed(F.avg("score")).alias("mean")
    )
    used = results.where("usable").select("query_id", "doc_id", F.lit(True).alias("is_used")).distinct()
    listed = lambda yes: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(yes, F.col("doc_id")))), lambda d: d.cast("string")), ",")
    chosen = selected.select("query_id", "doc_id").distinct().join(used, ["query_id", "doc_id"], "left")
    seen = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), listed(F.col("is_used").isNotNull()).alias("covered"), listed(F.col("is_used").isNull()).alias("missing"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return seen.join(sums, "query_id", "left").select("query_id", zero("retrieved"), zero("usable"), "least", "most", "mean", "documents", "covered", "missing")


def result_counts(results: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, doc_id, retrieved, usable for every selected document, zeros included."""
    sums = results.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("retrieved"), F.count_if("usable").alias("usable"))
    return selected.select("query_id", "doc_id").distinct().join(sums, ["query_id", "doc_id"], "left").na.fill(0, ["retrieved", "usable"])


def qa_sources(results: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """query_id, rank, doc_id, chunk_index, citation_no, section: the sources an answer is given.

    results: query_id, rank, doc_id, chunk_index, score, text. Ranks are dealt anew from 1; equal
    citations (document, chunk and excerpt) are numbered once, others are null; section is the text
    under its label.
    """
    rows = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("excerpt", excerpt(F.col(text_col)))
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id", "chunk_index", "excerpt").orderBy("rank")) == 1
    rows = rows.withColumn("is_first", first)
    number = F.sum(F.col("is_first").cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    section = F.concat(F.lit("[Source "), "rank", F.lit("]\n"), F.col(text_col))
    return rows.select("query_id", "rank", "doc_id", "chunk_index", F.when(F.col("is_first"), number).alias("citation_no"), section.alias("section"))


def result_traces(results: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """results' keys and rank, the score, and of the text a digest and a preview: what is logged."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return results.select("query_id", "rank", "doc_id", "chunk_index", fixed(F.col("score")).alias("score"), F.sha2(text, 256).alias("excerpt_sha256"), F.substring(normalize_whitespace(text), 1, PREVIEW).alias("preview"))


def shared_terms(queries: DataFrame, evidence: DataFrame, limit: int = 8, text_col: str = "text") -> DataFrame:
    """query_id, term, documents: those of a query's first terms (by count, then name) that two or
    more of its documents hold. evidence: query_id, doc_id, text."""
    each = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    asked = each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "term"))).where(F.col("place") <= limit)
    held = evidence.select("query_id", "doc_id", F.explode(term_set(F.col(text_col))).alias("term")).distinct()
    return asked.select("query_id", "term").join(held, ["query_id", "term"]).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")


def input_errors(contexts: DataFrame, selected: DataFrame) -> DataFrame:
    """group_id, doc_id, error: contexts (group_id, doc_id) of a document given twice or not selected."""
    counts = contexts.groupBy("group_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(selected.select("group_id", "doc_id", F.lit(True).alias("chosen")).distinct(), ["group_id", "doc_id"], "left")
    error = F.when(F.col("chosen").isNull(), "unselected_document").when(F.col("n") > 1, "duplicate_document")
    return rows.select("group_id", "doc_id", error.alias("error")).where("error IS NOT NULL")


def batch_scores(pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list], keys: tuple[str, ...], size: int = 64) -> DataFrame:
    """keys, model: the scores of an outside pair model, asked in batches of (query, text).

    scorer may answer with numbers or with objects that have score (or relevance_score) and index;
    what is wanting or no number is null. pairs: keys, query, text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                found: list = [None] * len(part)
                for place, answer in enumerate(scorer(list(zip(part["query"], part["text"])))):
                    value = answer
                    if isinstance(answer, dict):
                        place = answer.get("index", place)
                        value = answer.get("score", answer.get("relevance_score"))
                    if isinstance(value, (int, float)) and 0 <= place < len(found):
                        found[place] = float(value)
                out += found
            yield batch[list(keys)].assign(model=pd.Series(out, dtype="float64", index=batch.index))

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "query", "text").mapInPandas(run, f"{kinds}, model double")


def report_lines(table: DataFrame, title: str, columns: list[str], order: list[Column]) -> DataFrame:
    """line_no, line: a table as the lines of a Markdown report."""
    rows = table.withColumn("line_no", F.row_number().over(Window.orderBy(*order)) + 3)  # a report is short
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    body = rows.select("line_no", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = table.sparkSession.createDataFrame([(1, f"# {title}"), (2, "| " + " | ".join(columns) + " |"), (3, "|" + " --- |" * len(columns))], "line_no int, line string")
    return head.unionByName(body)
