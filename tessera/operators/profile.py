"""Document profiles: frequent terms, tags, entities, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.clauses import let
from tessera.functions.text import ENTITY, TAG_STOP_WORDS, ascii_words, normalize_whitespace, sentences, terms, unnest, unnest_numbered


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf, first_position (from 1, over meaningful tokens)."""
    each = unnest_numbered(docs, [F.col(id_col).alias("doc_id")], terms(F.col(text_col)), "p", "term")
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), (F.min("p") + 1).alias("first_position"))


def top_terms(docs: DataFrame, limit: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The most frequent terms of each document, ties by name: doc_id, term_rank, term, tf."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    ranked = term_counts(docs, id_col, text_col).withColumn("term_rank", F.row_number().over(order))
    return ranked.where(F.col("term_rank") <= limit).select("doc_id", "term_rank", "term", "tf")


def tags(docs: DataFrame, limit: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag_rank, tag: by count, then first occurrence, then name."""
    usable = term_counts(docs, id_col, text_col).where((F.length("term") >= 3) & ~F.col("term").isin(TAG_STOP_WORDS))
    order = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "first_position", "term")
    return usable.withColumn("tag_rank", F.row_number().over(order)).where(F.col("tag_rank") <= limit).select("doc_id", "tag_rank", F.col("term").alias("tag"))


def entities(docs: DataFrame, limit: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, entity_rank, entity, n: runs of capitalised words and acronyms, by count and name."""
    found = F.transform(F.regexp_extract_all(text_col, F.lit(f"({ascii_words(ENTITY)})"), F.lit(1)), normalize_whitespace)
    each = unnest(docs, [F.col(id_col).alias("doc_id")], F.filter(found, lambda e: F.length(e) >= 3), "entity")
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity")
    counted = each.groupBy("doc_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("entity_rank", F.row_number().over(order)).where(F.col("entity_rank") <= limit).select("doc_id", "entity_rank", "entity", "n")


def summary(docs: DataFrame, limit: int = 260, least: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, summary: the first two sentences of at least `least` characters, cut with an ellipsis;
    the text itself where there is none."""
    chosen = F.slice(F.filter(sentences(F.col(text_col)), lambda s: F.length(s) >= least), 1, 2)
    whole = F.when(F.size(chosen) > 0, F.array_join(chosen, " ")).otherwise(normalize_whitespace(F.col(text_col)))
    cut = F.when(F.length("whole") <= limit, F.col("whole")).otherwise(F.concat(F.trim(F.substring("whole", 1, limit - 1)), F.lit("...")))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), whole.alias("whole")).select("doc_id", cut.alias("summary"))


def group_by_tag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label, documents: how many documents have each first tag, or none."""
    first = tags(docs, 1, id_col, text_col).select("doc_id", F.col("tag").alias("label"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    return ids.join(first, "doc_id", "left").groupBy(F.coalesce("label", F.lit("untagged")).alias("label")).agg(F.count(F.lit(1)).alias("documents"))


def discover(docs: DataFrame, query: str, limit: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: documents that hold most of the query's terms as substrings of their search text, ties by id.

    Terms are letters and digits without spaces, so lower case and no NUL and CR are all of the search text
    that decides. Documents without a term are dropped after the limit: a filter before it would be pushed
    below and read each text again for every term.
    """
    from tessera.functions.text import STOP_WORDS

    import re

    wanted = list(dict.fromkeys(t for t in re.findall("[a-z0-9]+|[一-鿿]", query.lower()) if (len(t) > 1 or ord(t) > 127) and t not in STOP_WORDS))
    body = F.lower(F.replace(F.replace(F.col(text_col), F.lit("\x00"), F.lit("")), F.lit("\r"), F.lit("")))
    score = let(body, lambda b: sum((F.when(b.contains(t), 1).otherwise(0) for t in wanted), F.lit(0)))
    scored = docs.select(F.col(id_col).alias("doc_id"), score.cast("long").alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit).where("score > 0")
