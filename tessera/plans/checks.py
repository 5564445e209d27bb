"""Verdicts of evaluation cases, guarded revisions, memory notes, comparison batches and deletions.

Turns, orders, lines and events stand for cases, runs, changes and notes; what each column stands for is
said in the query's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.operators import evaluation, gates, index, state
from tessera.plans.tables import chunks, table


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers, every seventh of which begins with an abstention; every fifth conversation
    should abstain. Hits and support come from turn numbers and lengths."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.length(F.coalesce("text", F.lit("")))
    answer = F.concat(F.when(F.col("conv_id") % 7 == 0, F.lit(evaluation.ABSTENTIONS[0].upper() + ". ")).otherwise(""), F.coalesce("text", F.lit("")))
    abstained = evaluation.abstains(answer)
    passed = evaluation.case_passed(F.col("conv_id") % 5 == 0, abstained, n > 0, F.col("turn") % 2 == 1, n % 3 != 0, n % 4 != 0, n % 5 != 0)
    return rows.select("conv_id", "turn", abstained.alias("abstained"), passed.alias("passed"))


def expectation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as comparison cases: lines with flag A as claims of no difference, those with flag R as differences,
    their suppliers as documents; every seventh order abstains."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("same"), F.count_if(F.col("l_returnflag") == "R").alias("other"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey") % 3)).alias("documents")
    )
    expected = F.when(F.col("case_id") % 4 == 0, "no_difference").when(F.col("case_id") % 4 == 1, "difference").when(F.col("case_id") % 4 == 2, "abstain")
    passed, reason = evaluation.comparison_expectation(expected, F.col("case_id") % 7 == 0, F.col("same"), F.col("other"), F.col("documents"))
    return lines.select("case_id", passed.alias("passed"), reason.alias("reason"))


def case_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error on a day as failed cases: how many had none the day before, and what that means."""
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.to_date("ts").alias("day"), "user_id").distinct()
    before = failed.select(F.date_add("day", 1).alias("day"), "user_id", F.lit(True).alias("known"))
    rows = failed.join(before, ["day", "user_id"], "left").groupBy("day").agg(F.count_if(F.col("known").isNull()).alias("new_failures"))
    return rows.select(F.col("day").cast("string").alias("day"), "new_failures", gates.case_delta_status(F.col("new_failures")).alias("status"))


def revised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with a revision, all but every third stored; their lines as changes that expect one."""
    stored = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 4).cast("int").alias("revision"))
    changes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("int").alias("change_id")).agg(((F.col("run_id") + F.col("change_id")) % 4).cast("int").alias("expected_revision"))
    return state.compare_and_set(stored, changes)


def memory_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes of users, every third archived, and again as arrivals with other keys and texts."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner"), F.col("event_type").alias("category"))
    e = F.col("event_id")
    stored = events.select(e.alias("note_id"), "owner", "category", F.when(e % 2 == 0, F.concat(F.lit("k"), e % 5)).alias("key"), F.concat(F.lit("t"), e % 11).alias("text"), (e % 3 == 0).alias("archived"))
    arrivals = events.select(e.alias("arrival_id"), "owner", "category", F.when(e % 3 == 0, F.concat(F.lit("k"), e % 7)).alias("key"), F.concat(F.lit("t"), e % 13).alias("text"))
    return state.upsert_memories(stored, arrivals)


def compare_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as batches of two documents, which may be the same; all its suppliers as the selection."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("batch_no")).agg(F.max(F.col("l_suppkey") % 2).alias("a"), F.max(F.col("l_partkey") % 2).alias("b"))
    batches = lines.select("query_id", "batch_no", F.array("a", "b").alias("doc_ids"))
    selected = lines.groupBy("query_id").agg(F.array_sort(F.collect_set("a")).alias("doc_ids"))
    found = state.compare_batches(batches, selected)
    return found.select("query_id", F.col("batch_no").cast("int").alias("batch_no"), F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks left of each document after every third document was deleted from the index."""
    gone = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id")
    left = index.delete(chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk_text"), gone)
    return left.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk_text")).alias("characters"))


QUERIES = {f.__name__: f for f in (case_verdicts, expectation_reasons, case_deltas, revised_runs, memory_upserts, compare_batches, index_delete)}
ORACLES = {
    "case_verdicts": f"""
        WITH a AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS n, lower(CASE WHEN conv_id % 7 = 0 THEN '{evaluation.ABSTENTIONS[0].upper().replace("'", "''")}. ' ELSE '' END || coalesce(text, '')) AS low
            FROM conversations WHERE role = 'assistant'
        ),
        b AS (SELECT *, {" OR ".join("contains(low, '{}')".format(p.replace("'", "''")) for p in evaluation.ABSTENTIONS)} AS abstained, n > 0 AND turn % 2 = 1 AND n % 3 <> 0 AS base FROM a)
        SELECT conv_id, turn, abstained, CASE WHEN conv_id % 5 = 0 THEN abstained AND base ELSE NOT abstained AND base AND n % 4 <> 0 AND n % 5 <> 0 END AS passed FROM b
    """,
    "expectation_reasons": """
        WITH c AS (
            SELECT l_orderkey AS case_id, count(*) FILTER (l_returnflag = 'A') AS same, count(*) FILTER (l_returnflag = 'R') AS other, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey % 3 END) AS documents
            FROM lineitem GROUP BY ALL
        ),
        r AS (
            SELECT case_id, CASE case_id % 4
                WHEN 0 THEN CASE WHEN case_id % 7 = 0 THEN 'unexpected_abstention' WHEN other > 0 THEN 'supported_substantive_difference_present' WHEN same = 0 THEN 'missing_supported_no_difference_verdict' ELSE 'ok' END
                WHEN 1 THEN CASE WHEN case_id % 7 = 0 THEN 'unexpected_abstention' WHEN same > 0 THEN 'supported_no_difference_verdict_present' WHEN documents < 2 THEN 'missing_supported_cross_document_difference' ELSE 'ok' END
                WHEN 2 THEN CASE WHEN case_id % 7 = 0 THEN 'ok' ELSE 'missing_required_abstention' END
                ELSE 'not_applicable' END AS reason
            FROM c
        )
        SELECT case_id, reason IN ('ok', 'not_applicable') AS passed, reason FROM r
    """,
    "case_deltas": """
        WITH f AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'error'),
        n AS (SELECT a.day, count(*) FILTER (b.day IS NULL) AS new_failures FROM f a LEFT JOIN f b ON b.user_id = a.user_id AND b.day = a.day - 1 GROUP BY a.day)
        SELECT CAST(day AS VARCHAR) AS day, new_failures, CASE WHEN new_failures >= 2 THEN 'fail' WHEN new_failures = 1 THEN 'warn' ELSE 'pass' END AS status FROM n
    """,
    "revised_runs": """
        WITH c AS (SELECT DISTINCT l_orderkey AS run_id, CAST(l_linenumber AS INTEGER) AS change_id, CAST((l_orderkey + l_linenumber) % 4 AS INTEGER) AS expected FROM lineitem),
        h AS (SELECT c.*, CASE WHEN run_id % 3 <> 0 AND o_orderkey IS NOT NULL THEN CAST(run_id % 4 AS INTEGER) ELSE 0 END AS held, row_number() OVER (PARTITION BY run_id, expected ORDER BY change_id) AS turn FROM c LEFT JOIN orders ON o_orderkey = run_id)
        SELECT run_id, change_id, held = expected AND turn = 1 AS applied, held + CAST(held = expected AND turn = 1 AS INTEGER) AS revision FROM h
    """,
    "memory_upserts": """
        WITH s AS (SELECT event_id AS note_id, user_id AS owner, event_type AS category, CASE WHEN event_id % 2 = 0 THEN 'k' || event_id % 5 END AS key, 't' || event_id % 11 AS text FROM events WHERE event_id % 3 <> 0),
        k AS (SELECT owner, category, key, min(note_id) AS k FROM s WHERE key IS NOT NULL GROUP BY ALL),
        t AS (SELECT owner, category, text, min(note_id) AS t FROM s GROUP BY ALL),
        a AS (SELECT event_id AS arrival_id, user_id AS owner, event_type AS category, CASE WHEN event_id % 3 = 0 THEN 'k' || event_id % 7 END AS key, 't' || event_id % 13 AS text FROM events)
        SELECT arrival_id, coalesce(k, t) AS note_id, coalesce(k, t) IS NULL AS is_new FROM a LEFT JOIN k USING (owner, category, key) LEFT JOIN t USING (owner, category, text)
    """,
    "compare_batches": """
        WITH l AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS INTEGER) AS n, max(l_suppkey % 2) AS a, max(l_partkey % 2) AS b FROM lineitem GROUP BY ALL),
        g AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n) AS batch_no, a || ',' || b AS doc_ids FROM l WHERE a <> b)
        SELECT query_id, CAST(batch_no AS INTEGER) AS batch_no, doc_ids FROM g WHERE batch_no <= 5
        UNION ALL SELECT query_id, 1, string_agg(DISTINCT CAST(a AS VARCHAR), ',' ORDER BY CAST(a AS VARCHAR)) FROM l WHERE query_id NOT IN (SELECT query_id FROM g) GROUP BY query_id
    """,
    "index_delete": f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS characters FROM ({sql.chunks()}) WHERE doc_id % 3 <> 0 GROUP BY doc_id",
}
