"""Chunks, terms and profiles of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.scores import token_estimate
from tessera.functions.text import CHAPTER, NUMBERED, TAG_STOP_WORDS, TITLE_CASE, canonical_sentences, code_anchors, excerpt, normalize_search, normalize_whitespace, numeric_tokens
from tessera.operators import index, profile
from tessera.operators.chunking import section_lines, structured_chunks
from tessera.plans.tables import chunks, documents, table
from tessera.sources.files import page_texts


def fixed_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("chunk_text").alias("chunk_md5"))


def structured_chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured_chunks(documents(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section_heading", F.length("chunk_text").cast("long").alias("length"), F.md5("chunk_text").alias("chunk_md5"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(chunks(spark, sf_dir))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scores import fixed

    return index.corpus_statistics(chunks(spark, sf_dir)).select("n", F.col("terms").cast("long").alias("terms"), fixed(F.col("mean_length")).alias("mean_length"))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_terms(documents(spark, sf_dir)).withColumn("term_rank", F.col("term_rank").cast("long"))


def profile_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tags(documents(spark, sf_dir)).withColumn("tag_rank", F.col("tag_rank").cast("long"))


def profile_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entities(documents(spark, sf_dir)).withColumns({"entity_rank": F.col("entity_rank").cast("long")})


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(documents(spark, sf_dir))


def group_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_by_tag(documents(spark, sf_dir))


def document_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.discover(documents(spark, sf_dir), "Which document says token or license, version and worthless trash?", limit=8)


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(normalize_whitespace(text)).alias("tidy_md5"), F.md5(normalize_search(text)).alias("search_md5"), excerpt(text).alias("excerpt"), token_estimate(F.length("text")).cast("long").alias("tokens"))


def numeric_token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(numeric_tokens(F.col("text"))), " ").alias("numbers"))


def canonical_sentence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical_sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("sentences"), F.md5(F.array_join(F.array_sort(found), "\n")).alias("sentences_md5"))


def anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each document."""
    return documents(spark, sf_dir).select("doc_id", F.explode(code_anchors(F.col("text"))).alias("anchor"))


def section_line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = section_lines(documents(spark, sf_dir))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_heading").alias("headings"), F.count("section").alias("under_a_heading"))


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


QUERIES = {
    "fixed_window_chunks": fixed_window_chunks,
    "structured_chunks": structured_chunk_query,
    "term_df": term_df,
    "corpus_stats": corpus_stats,
    "top_terms": top_terms,
    "profile_tags": profile_tags,
    "profile_entities": profile_entities,
    "profile_summary": profile_summary,
    "group_by_tag": group_by_tag,
    "document_discovery": document_discovery,
    "normalized_texts": normalized_texts,
    "numeric_tokens": numeric_token_query,
    "canonical_sentences": canonical_sentence_query,
    "anchor_groups": anchor_groups,
    "section_lines": section_line_query,
    "html_texts": html_texts,
}

_ENTITY = r"\b(?:[A-Z][A-Za-z0-9&/-]{2,}(?:\s+[A-Z][A-Za-z0-9&/-]{2,}){0,4}|[A-Z]{2,})\b"
_POSITIONS = f"SELECT doc_id, unnest({sql.terms('text')}) AS term, generate_subscripts({sql.terms('text')}, 1) AS p FROM documents WHERE text IS NOT NULL"
_TAGS = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p), term) AS tag_rank, term AS tag
    FROM ({_POSITIONS}) WHERE length(term) >= 3 AND term NOT IN ({sql.quoted(TAG_STOP_WORDS)}) GROUP BY doc_id, term
"""


def _without_blocks(x: str) -> str:
    for name in ("script", "style", "noscript", "template"):
        x = rf"regexp_replace({x}, '(?is)<{name}\b.*?</{name}\s*>', ' ', 'g')"
    return x


def _unescaped(x: str) -> str:
    for name, by in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{by}')"
    return x


_WANTED = ["says", "token", "license", "version", "worthless", "trash"]

def _heading(line: str) -> str:
    compact = sql.strip(rf"regexp_replace({line}, '\s+', ' ', 'g')")
    letters, capitals = (f"length(regexp_replace({compact}, '[^{x}]', '', 'g'))" for x in ("A-Za-z", "A-Z"))
    forms = " OR ".join(sql.matches(compact, p) for p in (r"[:：]\z", NUMBERED, CHAPTER, TITLE_CASE))
    return f"({compact} <> '' AND length({line}) <= 90 AND len(string_split({compact}, ' ')) <= 12 AND ({forms} OR {capitals} * 10 > {letters} * 7))"


_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array({sql.normalize_whitespace('text')}, '\n+'), lambda p: {sql.normalize_whitespace('p')}), lambda p: p <> '')"
#: Long paragraphs are split, then pieces packed, each by a recursion over places; a last heading closes the last chunk.
_STRUCTURED = rf"""
    WITH RECURSIVE lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {_PARAGRAPHS} AS l FROM documents WHERE text IS NOT NULL)),
    long AS (
        SELECT doc_id, n, list_filter(list_transform(string_split(regexp_replace(line, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql.normalize_whitespace("x")}), lambda x: x <> '') AS s
        FROM lines WHERE length(line) > 900
    ),
    split AS (
        SELECT doc_id, n, s, 1 AS j, '' AS held, CAST([] AS VARCHAR[]) AS out FROM long
        UNION ALL
        SELECT doc_id, n, s, j + 1, CASE WHEN length(cand) <= 900 THEN cand WHEN held = '' THEN '' ELSE s[j] END,
               CASE WHEN length(cand) <= 900 THEN out WHEN held = '' THEN out || list_filter(list_transform(range(0, length(s[j]), 900), lambda i: {sql.strip("s[j][i + 1 : i + 900]")}), lambda x: x <> '') ELSE out || [held] END
        FROM (SELECT *, CASE WHEN held = '' THEN s[j] ELSE held || ' ' || s[j] END AS cand FROM split WHERE j <= len(s))
    ),
    parts AS (
        SELECT doc_id, n, 1 AS k, line AS t FROM lines WHERE length(line) <= 900
        UNION ALL SELECT doc_id, n, generate_subscripts(o, 1), unnest(o) FROM (SELECT doc_id, n, CASE WHEN held = '' THEN out ELSE out || [held] END AS o FROM split WHERE j > len(s))
    ),
    pieces AS MATERIALIZED (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, t, {_heading("t")} AS head FROM parts
        UNION ALL SELECT doc_id, count(*) + 1, '', true FROM parts GROUP BY doc_id
    ),
    packed AS (
        SELECT doc_id, 0 AS i, CAST(NULL AS VARCHAR) AS heading, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS done_heading, CAST(NULL AS VARCHAR) AS done FROM pieces GROUP BY doc_id
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN head THEN t ELSE heading END,
               CASE WHEN head THEN [] WHEN close THEN list_filter(held, lambda x, m: coalesce(list_sum(list_transform(held[m + 1:], lambda y: length(y))), 0) < 180) || [t] ELSE held || [t] END,
               CASE WHEN close THEN heading END, CASE WHEN close THEN CASE WHEN heading IS NULL THEN '' ELSE heading || chr(10) || chr(10) END || array_to_string(held, chr(10) || chr(10)) END
        FROM (
            SELECT packed.*, t, head, len(held) > 0 AND (head OR list_sum(list_transform(held, lambda y: length(y))) + 2 * len(held) + length(t) > 900) AS close
            FROM packed JOIN pieces ON pieces.doc_id = packed.doc_id AND pieces.i = packed.i + 1
        )
    )
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, done_heading AS section_heading, length(done) AS length, md5(done) AS chunk_md5 FROM packed WHERE done IS NOT NULL
"""

ORACLES = {
    "structured_chunks": _STRUCTURED,
    "fixed_window_chunks": f"SELECT doc_id, chunk_index, md5(chunk_text) AS chunk_md5 FROM ({sql.chunks()})",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT unnest({sql.term_set('chunk_text')}) AS term FROM ({sql.chunks()})) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS terms, {sql.fixed('avg(k)')} AS mean_length FROM (SELECT len({sql.terms('chunk_text')}) AS k FROM ({sql.chunks()}))",
    "top_terms": f"""
        SELECT doc_id, term_rank, term, tf FROM (
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS term_rank, term, count(*) AS tf
            FROM (SELECT doc_id, unnest({sql.terms("text")}) AS term FROM documents) GROUP BY doc_id, term
        ) WHERE term_rank <= 10
    """,
    "profile_tags": f"SELECT * FROM ({_TAGS}) WHERE tag_rank <= 12",
    "profile_summary": f"""
        SELECT doc_id, CASE WHEN length(whole) <= 260 THEN whole ELSE trim(substring(whole, 1, 259)) || '...' END AS summary FROM (
            SELECT doc_id, CASE WHEN len(long) > 0 THEN array_to_string(long[1:2], ' ') ELSE {sql.normalize_whitespace("text")} END AS whole FROM (
                SELECT doc_id, text, list_filter(list_transform({sql.raw_sentences("text")}, lambda s: {sql.strip("s")}), lambda s: length(s) >= 24) AS long
                FROM documents WHERE text IS NOT NULL
            )
        )
    """,
    "group_by_tag": f"""
        SELECT coalesce(tag, 'untagged') AS label, count(*) AS documents
        FROM documents LEFT JOIN (SELECT * FROM ({_TAGS}) WHERE tag_rank = 1) t USING (doc_id) GROUP BY 1
    """,
    "document_discovery": f"""
        SELECT doc_id, score FROM (
            SELECT doc_id, {" + ".join(f"CAST(contains(body, '{t}') AS BIGINT)" for t in _WANTED)} AS score
            FROM (SELECT doc_id, {sql.normalize_search("text")} AS body FROM documents)
        ) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 8
    """,
    "normalized_texts": rf"""
        SELECT doc_id, md5({sql.normalize_whitespace("text")}) AS tidy_md5, md5({sql.normalize_search("text")}) AS search_md5,
               substring({sql.strip(r"regexp_replace(text, '\s+', ' ', 'g')")}, 1, 220) AS excerpt,
               CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) END AS tokens
        FROM documents
    """,
    "numeric_tokens": f"SELECT doc_id, array_to_string(list_sort({sql.numeric_tokens('text')}), ' ') AS numbers FROM documents",
    "canonical_sentences": f"""
        SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, md5(array_to_string(list_sort(s), chr(10))) AS sentences_md5
        FROM (SELECT doc_id, {sql.canonical_sentences("text")} AS s FROM documents)
    """,
    "profile_entities": f"""
        SELECT doc_id, entity_rank, entity, n FROM (
            SELECT doc_id, entity, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, entity) AS entity_rank
            FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_ENTITY}'), lambda e: {sql.normalize_whitespace("e")})) AS entity FROM documents) WHERE length(entity) >= 3 GROUP BY doc_id, entity
        ) WHERE entity_rank <= 8
    """,
    "section_lines": rf"""
        SELECT doc_id, count(*) AS lines, count(*) FILTER (head) AS headings, count(*) FILTER (under) AS under_a_heading FROM (
            SELECT *, bool_or(head) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS under FROM (
                SELECT doc_id, n, {_heading('line')} AS head
                FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM (
                    SELECT doc_id, list_filter(list_transform(regexp_split_to_array({sql.normalize_whitespace("text")}, '\n+'), lambda p: {sql.normalize_whitespace("p")}), lambda p: p <> '') AS lines FROM documents WHERE text IS NOT NULL
                ))
            )
        ) GROUP BY doc_id
    """,
    "html_texts": rf"""
        SELECT page_id, {sql.strip(r"regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')")} AS text FROM (
            SELECT page_id, {_unescaped(r"regexp_replace(regexp_replace(regexp_replace(" + _without_blocks("html") + r", '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body|head)\b[^>]*|br\s*/?)>', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS t FROM pages
        )
    """,
    "anchor_groups": rf"""
        SELECT DISTINCT doc_id, anchor FROM (
            SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?i)\b[a-z0-9]{{2,}}(?:-[a-z0-9]+)+\b'), lambda a: {sql.normalize_search("a")})) AS anchor
            FROM documents
        ) WHERE len({sql.terms("anchor")}) > 0
    """,
}
