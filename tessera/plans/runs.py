"""Runs, steps and tasks over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.text import STOP_WORDS
from tessera.operators import facts, index, runs
from tessera.plans import retrieval
from tessera.plans.evaluation import user_questions
from tessera.plans.tables import chunks, questions, table

KINDS = list(runs.REPLAY) + ["unknown"]


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, every third with a wording put before it; a first turn has no documents."""
    said = F.element_at(F.array(*map(F.lit, WORDINGS)), (F.col("query_id") % len(WORDINGS) + 1).cast("int"))
    rows = user_questions(spark, sf_dir).select("query_id", F.concat(said, F.lit(" "), F.regexp_replace("query", r"\s+", " ")).alias("q"), (F.col("documents") > 1).alias("d"))
    return rows.select("query_id", F.array_join(runs.intent_candidates(F.col("q"), F.col("d")), ",").alias("intents"))


WORDINGS = [
    "", "Search arxiv for papers on", "Create a task about", "Organize project changes in my documents", "Compare the risks of", "Review the contract", "What changed across", "Show a timeline of",
    "Which document is about", "List documents on", "What is the latest news on", "Research", "Summarize the key terms of the agreement", "Save a summary of", "Are there gaps in",
]


def replay_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of all types, with a question, documents, a topic or a skill by their id."""
    given = F.array_compact(F.array(*[F.when(F.col("event_id") % n != 0, F.lit(name)) for n, name in ((3, "question"), (5, "docIds"), (2, "topic"), (4, "skillId"))]))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step_id"), kind.alias("type"), given.alias("inputs"), F.lit(False).alias("approved"))
    return runs.replay_safety(rows, ["document_rag", "research_question"])


def step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps of a customer's run; every second has no id, every third no status."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("s"), "o_orderkey")).alias("step_id"), F.lower("o_orderpriority").alias("type"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise(" ").alias("status"), F.lit("").alias("label"), (F.col("o_orderkey") % 4 - 0.5).alias("attempt"),
    )


def normalized_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.normalize_steps(step_rows(spark, sf_dir))


def upserted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth step done at a second attempt, and one step more for every fifth run."""
    steps = normalized_steps(spark, sf_dir)
    done = steps.where("seq % 10 = 0").select("run_id", "step_id", F.lit(None).cast("string").alias("type"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("label"), F.lit(2).cast("long").alias("attempt"))
    more = steps.where("run_id % 5 = 0").select("run_id").distinct().select("run_id", F.lit("final").alias("step_id"), F.lit("answer").alias("type"), F.lit("pending").alias("status"), F.lit("answer").alias("label"), F.lit(1).cast("long").alias("attempt"))
    return runs.upsert_steps(steps, done.unionByName(more))


def retried_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps of a customer's run; odd ones are retries of the order before. Those below 500 are tried again."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("s"), "l_linenumber").alias("step_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("s"), F.col("l_linenumber") - 1)).alias("retry_of"))
    return runs.retry_steps(rows, rows.where("run_id % 7 = 0"))


def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parts of a user's health."""
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 40), "error").when(F.col("value") > 90, "warn").otherwise("ok")
    return runs.overall_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status")))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "running").otherwise("done")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").alias("due_at"), F.col("ts").alias("leased_until"), (F.col("event_id") % 5).alias("attempt"), F.lit("w0").alias("worker"))


def claimed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.claim_tasks(_tasks(spark, sf_dir), "2024-01-15", "w1")[0].select("task_id", "status", "attempt", "worker")


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.claim_tasks(_tasks(spark, sf_dir), "2024-01-15", "w1")[1]


def archived_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts, of which those of customers of one nation are archived."""
    orders = table(spark, sf_dir, "orders")
    ids = orders.join(table(spark, sf_dir, "customer").where("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("artifact_id"))
    return runs.archive(orders.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderstatus").alias("status")), ids)


def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.with_chunk_text(spark, sf_dir, retrieval.sparse_candidates(spark, sf_dir)).join(questions(spark, sf_dir), "query_id")
    return runs.rerank_metrics(rows.withColumnRenamed("chunk_text", "text"))


def gap_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pass for passages whose first chunk covers too little: results that the first three didn't have."""
    read = index.read_once(chunks(spark, sf_dir), questions(spark, sf_dir))
    first = retrieval.sparse_candidates(spark, sf_dir, 3, read)
    best = retrieval.with_chunk_text(spark, sf_dir, first.where("rank = 1"))
    second = index.bm25_top_k(read, runs.supplemental_queries(questions(spark, sf_dir), best), 3)
    new = second.join(first.select("query_id", *retrieval.KEYS), ["query_id", *retrieval.KEYS], "left_anti")
    return retrieval.longs(new.select("query_id", *retrieval.KEYS, "score", "rank"), "chunk_index", "rank")


def fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a passage's best chunks: are the numbers of one those of another? Units must agree."""
    docs = retrieval.selected(spark, sf_dir)
    left = docs.select("group_id", F.col("doc_id").alias("claim_doc"), F.col("text").alias("claim"))
    pairs = left.join(docs.select("group_id", F.col("doc_id").alias("source_doc"), F.col("text").alias("source")), "group_id").where("claim_doc <> source_doc")
    return facts.fact_support(pairs, ("group_id", "claim_doc", "source_doc"), strict=True)


QUERIES = {
    f.__name__: f
    for f in (intents, replay_safety, normalized_steps, upserted_steps, retried_steps, overall_status, claimed_tasks, claim_events, archived_artifacts, rerank_metrics, gap_searches, fact_support)
}

_SAYS = {n: sql.matches("q", getattr(runs, n)) for n in ("ARXIV", "INVENTORY", "DISCOVERY", "RESEARCH", "CHRONOLOGY", "RISK_REVIEW", "CONTRACT_SUMMARY", "COMPARE", "CONTRACT_REVIEW", "RISKS", "PROJECT_CHANGE", "WEB")}
_ACTION = "CASE " + " ".join(f"WHEN {sql.matches('q', p)} THEN '{name}'" for name, p in runs.ACTIONS.items()) + " END"
_INTENTS = [
    ("arxiv_import", _SAYS["ARXIV"]), ("workspace_action", f"NOT ({_SAYS['ARXIV']}) AND action IS NOT NULL AND NOT (action = 'document.organize' AND {_SAYS['PROJECT_CHANGE']})"),
    ("skill_chain_compare_risk", f"{_SAYS['COMPARE']} AND {_SAYS['RISKS']}"), ("skill_chain_contract_review", f"({_SAYS['RISK_REVIEW']} AND {_SAYS['CONTRACT_SUMMARY']}) OR {_SAYS['CONTRACT_REVIEW']}"),
    ("skill_chain_project_change", _SAYS["PROJECT_CHANGE"]), ("extract_timeline", _SAYS["CHRONOLOGY"]), ("compare_documents", _SAYS["COMPARE"]), ("risk_review", _SAYS["RISK_REVIEW"]),
    ("summarize_contract", _SAYS["CONTRACT_SUMMARY"]), ("research_brief", _SAYS["RESEARCH"]), ("inventory", f"{_SAYS['INVENTORY']} AND NOT d"), ("document_discovery", f"{_SAYS['DISCOVERY']} AND NOT d"),
    ("web", f"{_SAYS['WEB']} AND NOT d"), ("document_web", _SAYS["WEB"]), ("document", f"NOT ({_SAYS['WEB']})"),
]
_STEPS = """
    SELECT o_custkey AS run_id, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey ELSE 'step:' || o_orderkey || ':' || lower(o_orderpriority) END AS step_id, lower(o_orderpriority) AS type,
           CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE 'pending' END AS status, lower(o_orderpriority) AS label, CAST(CASE WHEN o_orderkey % 4 >= 2 THEN o_orderkey % 4 - 1 ELSE 1 END AS BIGINT) AS attempt FROM orders
"""
_DUE = "(event_id % 3 = 0 OR event_id % 3 = 1) AND ts <= TIMESTAMP '2024-01-15'"


def _needs(kind: str, names: list[str]) -> str:
    there = {"question": 3, "docIds": 5, "topic": 2, "skillId": 4}
    return " OR ".join(f"event_id % {there[n]} = 0" if n in there else "true" for n in names)


_UNIT = f"coalesce({{map}}[lower(u)], {{map}}[regexp_replace(lower(u), 's$', '')], regexp_replace(lower(u), '(..)s$', '\\1'))".format(map="MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in facts.UNITS.items()) + "}")
_UNIT = f"CASE WHEN lower(u) IN ({sql.quoted(STOP_WORDS)}) THEN '' ELSE {_UNIT} END"

ORACLES = {
    "fact_support": rf"""
        {retrieval._RANKED}, d AS MATERIALIZED (SELECT DISTINCT query_id AS group_id, doc_id, {sql.normalize_whitespace("text")} AS t FROM sparse JOIN documents USING (doc_id) WHERE rank <= {retrieval.TOP_K}),
        e AS (SELECT group_id, doc_id, unnest(regexp_extract_all(t, '{facts.FACT}', 1)) AS c, {sql.number(f"unnest(regexp_extract_all(t, '{facts.FACT}', 2))")} AS v, coalesce(unnest(regexp_extract_all(t, '{facts.FACT}', 3)), '') AS u FROM d),
        f AS (SELECT group_id, doc_id, CASE WHEN c <> '' THEN c WHEN {_UNIT} IN ('$', '€') THEN {_UNIT} ELSE '' END AS c, v, CASE WHEN {_UNIT} IN ('$', '€') THEN '' ELSE {_UNIT} END AS u FROM e),
        n AS MATERIALIZED (SELECT group_id, doc_id, c, v, u, count(*) AS k FROM f GROUP BY ALL),
        p AS (SELECT l.group_id, l.doc_id AS claim_doc, r.doc_id AS source_doc FROM d l JOIN d r ON l.group_id = r.group_id AND l.doc_id <> r.doc_id),
        m AS (SELECT l.group_id, l.doc_id AS claim_doc, r.doc_id AS source_doc, sum(least(l.k, r.k)) AS matched FROM n l JOIN n r ON l.group_id = r.group_id AND l.c = r.c AND l.v = r.v AND l.u = r.u GROUP BY ALL),
        s AS (SELECT group_id, doc_id AS claim_doc, sum(k) AS facts FROM n GROUP BY ALL)
        SELECT group_id, claim_doc, source_doc, CAST(coalesce(facts, 0) AS BIGINT) AS facts, CAST(coalesce(matched, 0) AS BIGINT) AS matched, coalesce(facts, 0) = coalesce(matched, 0) AS supported
        FROM p LEFT JOIN s USING (group_id, claim_doc) LEFT JOIN m USING (group_id, claim_doc, source_doc)
    """,
    "intents": rf"""
        SELECT query_id, concat_ws(',', {", ".join(f"CASE WHEN {yes} THEN '{name}' END" for name, yes in _INTENTS)}) AS intents
        FROM (SELECT *, {_ACTION} AS action FROM (
            SELECT conv_id * 1000 + turn AS query_id, turn > 0 AS d, [{", ".join(f"'{w}'" for w in WORDINGS)}][(conv_id * 1000 + turn) % {len(WORDINGS)} + 1] || ' ' || regexp_replace(text, '\s+', ' ', 'g') AS q
            FROM conversations WHERE role = 'user'
        ))
    """,
    "replay_safety": f"""
        SELECT user_id AS run_id, event_id AS step_id, reasons = '' AS safe, reasons FROM (
            SELECT user_id, event_id, CASE kind {" ".join(
                f"WHEN '{k}' THEN concat_ws(',', CASE WHEN {_needs(k, v[3])} THEN 'missing_input' END" + (", 'requires_approval'" if v[2] else "")
                + (", 'external_write'" if v[1] == "deduped_workspace_write" else ", 'non_idempotent'" if v[1] in ("capability_defined", "external_read_nondeterministic") else "")
                + (f", CASE WHEN NOT ({_needs(k, v[3])}) THEN 'unsafe_by_policy' END" if v[0] and k not in ("document_rag", "research_question") else "") + ")"
                for k, v in runs.REPLAY.items()
            )} ELSE 'unsupported_step_type' END AS reasons
            FROM (SELECT *, [{", ".join(f"'{k}'" for k in KINDS)}][event_id % {len(KINDS)} + 1] AS kind FROM events)
        )
    """,
    "normalized_steps": _STEPS,
    "upserted_steps": f"""
        WITH s AS ({_STEPS})
        SELECT run_id, seq, step_id, type, CASE WHEN seq % 10 = 0 THEN 'completed' ELSE status END AS status, label, CASE WHEN seq % 10 = 0 THEN 2 ELSE attempt END AS attempt FROM s UNION ALL
        SELECT run_id, max(seq) + 1, 'final', 'answer', 'pending', 'answer', 1 FROM s WHERE run_id % 5 = 0 GROUP BY run_id
    """,
    "retried_steps": """
        WITH l AS (SELECT l_orderkey AS run_id, l_linenumber AS n, 's' || CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 1 ELSE l_linenumber END AS root FROM lineitem WHERE l_orderkey % 7 = 0),
        t AS (SELECT run_id, root, count(*) AS tries FROM l GROUP BY ALL), w AS (SELECT DISTINCT run_id, 's' || n AS step_id FROM l)
        SELECT run_id, step_id || ':retry:' || (tries + 1) AS step_id, step_id AS retry_of, tries + 1 AS attempt, 'pending' AS status FROM w JOIN t USING (run_id) WHERE root = step_id
    """,
    "overall_status": "SELECT user_id AS run_id, CASE WHEN bool_or(event_type = 'error' AND value > 40) THEN 'error' WHEN bool_or(value > 90) THEN 'warn' ELSE 'ok' END AS status FROM events GROUP BY user_id",
    "claimed_tasks": f"""
        SELECT event_id AS task_id, CASE WHEN {_DUE} THEN 'running' WHEN event_id % 3 = 0 THEN 'queued' WHEN event_id % 3 = 1 THEN 'running' ELSE 'done' END AS status,
               event_id % 5 + CASE WHEN {_DUE} THEN 1 ELSE 0 END AS attempt, CASE WHEN {_DUE} THEN 'w1' ELSE 'w0' END AS worker FROM events
    """,
    "claim_events": f"SELECT event_id AS task_id, 'claimed' AS event, event_id % 5 + 1 AS attempt, 'w1' AS worker FROM events WHERE {_DUE}",
    "archived_artifacts": "SELECT o_orderkey AS artifact_id, CASE WHEN c_nationkey = 3 THEN 'archived' ELSE o_orderstatus END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "rerank_metrics": f"{retrieval._RANKED} SELECT query_id, count(*) AS candidates, CAST(max(length(query)) AS BIGINT) AS query_characters, CAST(sum(length(chunk_text)) AS BIGINT) AS text_characters FROM sparse JOIN c USING (doc_id, chunk_index) JOIN q USING (query_id) GROUP BY query_id",
    "gap_searches": f"""
        {retrieval._RANKED}, one AS (SELECT query_id, list_filter(wanted, lambda t: NOT list_contains(terms, t)) AS lack, len(list_intersect(wanted, terms)) / len(wanted) AS share FROM q JOIN sparse USING (query_id) JOIN c USING (doc_id, chunk_index) WHERE rank = 1),
        again AS (SELECT query_id, lack FROM one WHERE share < 0.6 AND len(lack) > 0),
        lacking AS (SELECT query_id, unnest(lack) AS term FROM again),
        s AS (
            SELECT query_id, doc_id, chunk_index, {sql.fixed("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))", 6)} AS score, {sql.fixed("count(*) / any_value(k)", 6)} AS keyword
            FROM tf JOIN lacking USING (term) JOIN df USING (term) JOIN (SELECT query_id, len(lack) AS k FROM again) USING (query_id) CROSS JOIN stats GROUP BY query_id, doc_id, chunk_index
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword DESC, doc_id, chunk_index) AS rank FROM s)
        SELECT query_id, doc_id, chunk_index, r.score, r.rank FROM r ANTI JOIN (SELECT query_id, doc_id, chunk_index FROM sparse WHERE rank <= 3) f USING (query_id, doc_id, chunk_index) WHERE r.rank <= 3
    """,
}
