"""Evaluation runs, questions and stores, over what the retrieval plans find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.scores import fixed
from tessera.functions.text import STOP_WORDS, normalize_search
from tessera.operators import evaluation, index, profile, questions as asking, retrieval as rank, state
from tessera.plans import answers, retrieval
from tessera.plans.tables import chunks, documents, holders, questions, table
from tessera.sources.scratch import kept


def answer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in the form in which answers are matched."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(evaluation.match_form(F.col("text"))).alias("form_md5"))


def coverage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as cases: are all documents that hold them among the best six chunks?"""
    cited = retrieval.sparse_candidates(spark, sf_dir, 6).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("doc_key"), F.lit(1).alias("page_number"))
    expected = holders(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("doc_key"), F.lit(None).cast("int").alias("page_number"))
    return evaluation.coverage(questions(spark, sf_dir).select(F.col("query_id").alias("case_id")), cited, expected)


def planner_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first order priority as signature: customers of even orders against odd ones."""
    rows = table(spark, sf_dir, "orders")
    run = lambda k: rows.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("case_id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("signature"))
    return evaluation.divergence(run(0), run(1))


def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last event differs between two days in type or value."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    at = lambda day: state.latest_snapshot(rows.where(F.col("ts") < F.lit(day).cast("timestamp_ntz")), ("user_id",), ["ts", "event_id"])
    return state.changed_rows(at("2024-01-15"), at("2024-01-16"), ("user_id",), ("event_type", "value"))


def duplicate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an arrival among those of smaller id: by text, by search text, by first line."""
    text = F.col("text")
    rows = documents(spark, sf_dir).select("doc_id", F.md5(text).alias("text_hash"), F.md5(normalize_search(text)).alias("search_hash"), F.md5(F.substring_index(text, "\n", 1)).alias("title_hash"))
    return state.match_duplicates(rows, rows, ("text_hash", "search_hash", "title_hash"), earlier=True)


def citations_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.citations_by_document(retrieval.sparse_candidates(spark, sf_dir))


def attached_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked results as citations of the sparse results by rank: only equal chunks attach."""
    candidates = retrieval.sparse_candidates(spark, sf_dir)
    cited = retrieval.reranked(spark, sf_dir, 18, candidates).select(F.col("query_id").alias("answer_id"), "rank", "doc_id", "chunk_index")
    found = candidates.select(F.col("query_id").alias("answer_id"), "rank", F.col("rank").alias("position"), "doc_id", "chunk_index", F.concat_ws(":", "doc_id", "chunk_index").alias("text"))
    return state.attach_evidence(cited, found).select("answer_id", F.col("rank").cast("long").alias("rank"), "evidence")


def budgeted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as steps, within sixteen of which views don't count."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type")
    return state.within_budget(rows, 16, counted=F.col("event_type") != "view").select("run_id", "seq", "used")


def recoverable_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps of a customer's run: priority as type, status as state."""
    kind = F.when(F.col("o_orderpriority").startswith("1"), "approval_gate").when(F.col("o_orderpriority").startswith("5"), "retrieve").otherwise("write")
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 5 == 0), "paused").otherwise("completed")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), kind.alias("type"), status.alias("status"))
    return state.recoverable_steps(rows, ["retrieve"])


def experience_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes of their source, with the last digit of the id as confidence."""
    notes = documents(spark, sf_dir).select(F.col("source").alias("owner"), F.col("doc_id").alias("note_id"), "text", (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    return state.rank_experience(notes, "license version token trash worthless apache").withColumn("place", F.col("place").cast("long"))


def remembered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.remembered_claims(answers.claim_support(spark, sf_dir))


def evidence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.evidence_gaps(answers.answer_verdicts(spark, sf_dir))


def reference_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as pages: a passage of even id expects all pages of the documents that hold it, others the first two."""
    held = kept(holders(spark, sf_dir))
    named = held.where("query_id % 2 = 1").select("query_id", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("page_number"))
    expected = held.where("query_id % 2 = 0").withColumn("page_number", F.lit(None).cast("int")).unionByName(named)
    pages = chunks(spark, sf_dir).select(F.col("doc_id").alias("doc_key"), F.col("chunk_index").alias("page_number"), F.col("chunk_text").alias("text"))
    found = evaluation.reference_contexts(expected.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("doc_key"), "page_number"), pages)
    return found.select("case_id", "doc_key", F.col("page_number").cast("long").alias("page_number"), F.md5("text").alias("text_md5"))


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("text").alias("query"), (F.col("turn") + 1).alias("documents"))


def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.plan(user_questions(spark, sf_dir))


def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.decompose(user_questions(spark, sf_dir))


def external_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, with the terms of the conversation's other turns as secrets."""
    asked = user_questions(spark, sf_dir)
    from tessera.functions.text import term_set

    others = table(spark, sf_dir, "conversations").where("role <> 'user'").select("conv_id", F.explode(term_set(F.col("text"))).alias("term"))
    return asking.external_queries(asked, asked.select("query_id", "conv_id").join(others, "conv_id").select("query_id", "term"), STOP_WORDS)


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieval.with_chunk_text(spark, sf_dir, retrieval.sparse_candidates(spark, sf_dir)).join(questions(spark, sf_dir), "query_id")
    return retrieval.longs(rank.minmax_rerank(results, asking.lexical_pair_score(F.col("query"), F.col("chunk_text")), 6), "chunk_index", "rank")


def evidence_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.gaps(questions(spark, sf_dir), retrieval.with_chunk_text(spark, sf_dir, retrieval.sparse_candidates(spark, sf_dir, 6)))


def topic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tags = profile.tags(docs, 4).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_rank", "tag"))), lambda t: t["tag"]).alias("tags"))
    return asking.topic_phrases(profile.summary(docs).join(tags, "doc_id"))


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequencies of chunks after every tenth document is replaced by its first 300 characters."""
    from tessera.operators.chunking import fixed_windows

    docs = documents(spark, sf_dir)
    changed = fixed_windows(docs.where("doc_id % 10 = 0").withColumn("text", F.substring("text", 1, 300)))
    return index.document_frequency(index.replace_documents(fixed_windows(docs), changed))


QUERIES = {
    f.__name__: f
    for f in (
        answer_matches, coverage_hits, planner_divergence, snapshot_conflicts, duplicate_matches, citations_by_document, attached_evidence, budgeted_steps, recoverable_steps,
        experience_ranking, remembered_claims, evidence_gaps, reference_contexts, question_plans, question_parts, external_queries, lexical_rerank, evidence_requirements, topic_phrases, index_upsert,
    )
}


def _match_form(x: str) -> str:
    out = rf"regexp_replace(lower({x}), '(\d),(\d)', '\1\2', 'g')"
    for word, n in evaluation.NUMBER_WORDS.items():
        out = rf"regexp_replace({out}, '\b{word}\b', chr(1) || '{n}' || chr(2), 'g')"
    out = rf"regexp_replace({out}, '\x01([2-9])0\x02[-\s]+\x01([1-9])\x02', '\1\2', 'g')"
    return sql.strip(rf"regexp_replace(regexp_replace({out}, '[\x01\x02]', '', 'g'), '\s+', ' ', 'g')")


_last = "SELECT user_id, max_by(event_type, (ts, event_id)) AS t, max_by(value, (ts, event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-{d}' GROUP BY user_id"
_hash = f"SELECT doc_id, md5(text) AS k1, md5({sql.normalize_search('text')}) AS k2, md5(string_split(text, chr(10))[1]) AS k3 FROM documents"
_first = "SELECT o_custkey AS case_id, min_by(o_orderpriority, o_orderkey) AS s FROM orders WHERE o_orderkey % 2 = {k} GROUP BY o_custkey"
_R = retrieval._RANKED
_ASKED_TERMS = "['license', 'version', 'token', 'trash', 'worthless', 'apache']"

ORACLES = {
    "answer_matches": f"SELECT conv_id, turn, md5({_match_form('text')}) AS form_md5 FROM conversations",
    "coverage_hits": f"""
        {_R}, {retrieval._HOLDERS}, six AS (SELECT DISTINCT query_id, doc_id FROM sparse WHERE rank <= 6),
        e AS (SELECT query_id, bool_and(six.doc_id IS NOT NULL) AS hit FROM held LEFT JOIN six USING (query_id, doc_id) GROUP BY query_id)
        SELECT item_id AS case_id, coalesce(hit, item_id NOT IN (SELECT query_id FROM six)) AS doc_hit, coalesce(hit, item_id NOT IN (SELECT query_id FROM six)) AS page_hit
        FROM benchmark LEFT JOIN e ON item_id = query_id
    """,
    "planner_divergence": f"""
        SELECT case_id, CASE WHEN b.s IS NULL THEN 'missing_compare_case' WHEN a.s IS NULL THEN 'missing_provider_case' ELSE 'planner_signature_mismatch' END AS reason
        FROM ({_first.format(k=0)}) a FULL JOIN ({_first.format(k=1)}) b USING (case_id) WHERE a.s IS DISTINCT FROM b.s
    """,
    "snapshot_conflicts": f"SELECT user_id FROM ({_last.format(d=15)}) a JOIN ({_last.format(d=16)}) b USING (user_id) WHERE a.t IS DISTINCT FROM b.t OR a.v IS DISTINCT FROM b.v",
    "duplicate_matches": f"""
        WITH h AS ({_hash}), m AS (SELECT doc_id, {", ".join(f"nullif(min(doc_id) OVER (PARTITION BY k{i}), doc_id) AS m{i}" for i in (1, 2, 3))} FROM h)
        SELECT doc_id, coalesce(m1, m2, m3) AS match_id, CASE WHEN m1 IS NOT NULL THEN 'text_hash' WHEN m2 IS NOT NULL THEN 'search_hash' WHEN m3 IS NOT NULL THEN 'title_hash' END AS matched_by FROM m
    """,
    "reference_contexts": f"""
        WITH {retrieval._HOLDERS}, p AS ({sql.chunks()})
        SELECT query_id AS case_id, doc_id AS doc_key, chunk_index AS page_number, md5(chunk_text) AS text_md5 FROM held JOIN p USING (doc_id) WHERE query_id % 2 = 0 OR chunk_index < 2
    """,
    "citations_by_document": f"""
        {_R} SELECT query_id, doc_id, count(*) AS citations, array_to_string(list_transform(list_sort(list_distinct(list(chunk_index))), lambda x: CAST(x AS VARCHAR)), ',') AS places
        FROM sparse GROUP BY query_id, doc_id
    """,
    "attached_evidence": f"""
        {_R}, {retrieval._RERANKED}
        SELECT r.query_id AS answer_id, r.rank, CASE WHEN s.doc_id IS NOT NULL THEN s.doc_id || ':' || s.chunk_index END AS evidence
        FROM reranked r LEFT JOIN sparse s ON r.query_id = s.query_id AND r.rank = s.rank AND r.doc_id = s.doc_id AND r.chunk_index = s.chunk_index
    """,
    "budgeted_steps": """
        SELECT run_id, seq, CAST(used AS BIGINT) AS used FROM (
            SELECT user_id AS run_id, event_id AS seq, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM events
        ) WHERE used <= 16
    """,
    "recoverable_steps": """
        SELECT o_custkey AS run_id,
               CASE WHEN bool_or(p AND o_orderpriority LIKE '1%') THEN 'pending_approval_gate' WHEN bool_or(p AND o_orderpriority LIKE '5%') THEN 'safe_step_ready'
                    WHEN bool_or(p) THEN 'unsafe_step_type' ELSE 'no_safe_recoverable_step' END AS reason,
               CASE WHEN NOT bool_or(p AND o_orderpriority LIKE '1%') THEN min(o_orderkey) FILTER (p AND o_orderpriority LIKE '5%') END AS step
        FROM (SELECT *, o_orderstatus = 'O' AND o_orderkey % 5 = 0 AS p FROM orders) GROUP BY o_custkey
    """,
    "experience_ranking": f"""
        SELECT owner, note_id, weight, place FROM (
            SELECT *, row_number() OVER (PARTITION BY owner ORDER BY weight DESC, note_id) AS place FROM (
                SELECT source AS owner, doc_id AS note_id, {sql.fixed("share + doc_id % 10 / 10.0", 6)} AS weight
                FROM (SELECT *, len(list_intersect({_ASKED_TERMS}, {sql.term_set("text")})) / 6 AS share FROM documents) WHERE share > 0 AND doc_id % 10 / 10.0 >= 0.45
            )
        ) WHERE place <= 6
    """,
    "index_upsert": f"""
        WITH old AS ({sql.chunks()}), new AS ({sql.chunks().replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT doc_id, substring(text, 1, 300) AS text FROM documents WHERE doc_id % 10 = 0) WHERE text IS NOT NULL")}),
        merged AS (SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new)
        SELECT term, count(*) AS df FROM (SELECT unnest({sql.term_set("chunk_text")}) AS term FROM merged) GROUP BY term
    """,
}
