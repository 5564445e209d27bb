"""Summaries, traces and reports of retrieval, and planning, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.text import clean_page, normalize_token
from tessera.operators import metrics, planning, state, summaries
from tessera.plans import retrieval
from tessera.plans.evaluation import user_questions
from tessera.plans.tables import documents, questions, table


def judged(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Reranked results, usable from a score of 0.3 on. found: sparse_candidates(), where the caller needs them too."""
    return retrieval.with_chunk_text(spark, sf_dir, retrieval.reranked(spark, sf_dir, candidates=found)).withColumn("usable", F.col("score") >= 0.3)


def judged_and_chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """judged(), and the documents of the candidates, from one search."""
    found = retrieval.sparse_candidates(spark, sf_dir)
    return judged(spark, sf_dir, found), found.select("query_id", "doc_id").distinct()


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.evidence_summary(*judged_and_chosen(spark, sf_dir))


def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.result_counts(*judged_and_chosen(spark, sf_dir))


def qa_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.longs(summaries.qa_sources(judged(spark, sf_dir)), "rank", "chunk_index", "citation_no").withColumn("section", F.md5("section"))


def result_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.longs(summaries.result_traces(judged(spark, sf_dir)), "rank", "chunk_index")


def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.shared_terms(questions(spark, sf_dir), retrieval.selected(spark, sf_dir).withColumnRenamed("group_id", "query_id"))


def input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the best six as contexts, where the documents of the best three are selected."""
    given = retrieval.sparse_candidates(spark, sf_dir, retrieval.TOP_K).select(F.col("query_id").alias("group_id"), "doc_id", "rank")
    return summaries.input_errors(given, given.where("rank <= 3"))


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored in batches by the share of words that query and chunk have in common."""

    def scorer(pairs: list[tuple[str, str]]) -> list[dict]:
        sets = [(set(a.split()), set(b.split())) for a, b in pairs]
        return [{"index": k, "score": len(a & b) / len(a | b)} for k, (a, b) in enumerate(sets)][::-1]

    rows = retrieval.with_chunk_text(spark, sf_dir, retrieval.sparse_candidates(spark, sf_dir)).join(questions(spark, sf_dir), "query_id").withColumnRenamed("chunk_text", "text")
    scored = summaries.batch_scores(rows, scorer, ("query_id", "doc_id", "chunk_index"))
    return retrieval.longs(scored, "chunk_index").withColumn("model", F.floor(F.col("model") * 1e6 + 0.5) / 1e6)


def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as a Markdown report."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("newest"))
    return retrieval.longs(summaries.report_lines(rows, "Orders", ["o_orderstatus", "orders", "newest"], [F.col("o_orderstatus")]), "line_no")


def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' market segments as variants of a sweep, their balances and keys as its rates."""
    share = lambda yes: F.avg(F.when(yes, 1.0).otherwise(0.0))
    runs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("variant")).agg(
        share(F.col("c_acctbal") > 0).alias("pass_rate"), share(F.col("c_custkey") % 2 == 0).alias("qa_page_hit"), share(F.col("c_custkey") % 3 == 0).alias("compare_page_hit"),
        share(F.col("c_nationkey") > 9).alias("content_hit"), share(F.col("c_acctbal") > 1000).alias("claim_support"), F.lit(None).cast("double").alias("upload_resume"),
        F.avg(F.col("c_nationkey").cast("double")).alias("response_ms"), F.lit(1.0).alias("citations"), (F.max("c_custkey") > 0).alias("completed"),
    )
    return retrieval.longs(metrics.quality_ranking(runs), "place")


def judge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged cases: type as route, value and a third of it as metrics, of which every fifth lacks one."""
    route = F.when(F.col("event_type") == "view", "qa").when(F.col("event_type") == "click", "compare").when(F.col("event_type") == "error", "abstain").otherwise(F.col("event_type"))
    cases = table(spark, sf_dir, "events").select(route.alias("route"), F.floor("value").alias("relevancy"), F.when(F.col("event_id") % 5 != 0, F.floor(F.col("value") / 3)).alias("faithfulness"))
    return retrieval.longs(metrics.judge_averages(cases, ["relevancy", "faithfulness"]), "place")


def named_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.named_variants(spark)


def audit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and of a day; and none, where another user's are asked for."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    own = state.audit_filter(rows, {"user_id": 7}, {"user_id": 7}, start="2024-01-03", end="2024-01-20")
    other = state.audit_filter(rows, {"user_id": 7}, {"user_id": 8}, start="2024-01-03", end="2024-01-20")
    return state.audit_page(own.unionByName(other), 0, "all", []).select("event_id", "total")


def spelled(n: Column) -> Column:
    """A whole number below a thousand millions in English words."""
    words = {v: k for k, v in planning.NUMBER_VALUES.items()}
    known = F.create_map(*[x for v, k in words.items() for x in (F.lit(v), F.lit(k))])

    def below_thousand(k: Column) -> Column:
        rest = k % 100
        tens = F.when(rest == 0, None).when(rest <= 20, known[rest.cast("int")]).otherwise(F.concat_ws("-", known[(rest - rest % 10).cast("int")], F.when(rest % 10 > 0, known[(rest % 10).cast("int")])))
        hundreds = F.when(k >= 100, F.concat(known[F.floor(k / 100).cast("int")], F.lit(" hundred")))
        return F.concat_ws(" and ", hundreds, tens)

    part = lambda size, name: F.when(F.floor(n / size) % 1000 > 0, F.concat(below_thousand(F.floor(n / size) % 1000), F.lit(name)))
    return F.when(n == 0, "zero").otherwise(F.concat_ws(" ", part(1_000_000, " million"), part(1_000, " thousand"), part(1, "")))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders spelled out and read again; and in Chinese characters, the line's number times a thousand."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    digits = F.element_at(F.array(*map(F.lit, "一二三四五六七八九")), (F.col("n") % 9 + 1).cast("int"))
    return rows.select("n", planning.english_number(spelled(F.col("n"))).cast("long").alias("english"), planning.chinese_number(F.concat(digits, F.lit("万"), digits, F.lit("千零"), digits)).cast("long").alias("chinese"))


def normalized_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plans, their turns as queries, of which system-like blanks and ids are wanting."""
    turns = table(spark, sf_dir, "conversations")
    queries = turns.select(F.col("conv_id").alias("plan_id"), (F.col("turn") + 1).alias("position"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("q"), "turn")).alias("query_id"), F.lit("").alias("label"), F.when(F.col("turn") % 3 != 1, F.concat(F.lit(" "), F.md5("text"), F.lit("\n"))).otherwise(" ").alias("query"), F.when(F.col("turn") == 0, True).alias("is_primary"))
    options = turns.where("turn = 0").select(F.col("conv_id").alias("plan_id"), F.lit("").alias("source"), F.lit(None).cast("string").alias("phase"), F.when(F.col("conv_id") % 2 == 0, "fact").alias("intent"), F.lit(None).cast("string").alias("profile"), (F.col("conv_id") % 7 - 1.5).alias("top_k"), (F.col("conv_id") % 3).cast("double").alias("top_k_per_doc"))
    return retrieval.longs(planning.normalize_plan(queries, options), "query_no")


def research_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as topics, the roles of their conversation's turns as file names."""
    asked = user_questions(spark, sf_dir)
    names = asked.select("query_id", "conv_id").join(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.concat("role", F.lit("-"), "turn").alias("file_name")), "conv_id")
    return planning.research_plans(asked.select("query_id", "query"), names).withColumn("question", F.md5("question"))


def paper_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a passage's best chunks as papers, their first line as title."""
    found = retrieval.sparse_candidates(spark, sf_dir, retrieval.TOP_K).select("query_id", "doc_id").distinct()
    papers = found.join(documents(spark, sf_dir), "doc_id").join(questions(spark, sf_dir), "query_id")
    return planning.paper_relevance(papers.select(F.col("doc_id").alias("paper_id"), "query_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"), F.col("query").alias("topic")))


def sensitive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as values, and words of their conversation's system turn as secrets of it."""
    turns = table(spark, sf_dir, "conversations")
    values = turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("value_id"), F.col("conv_id").alias("owner"), F.when(F.col("conv_id") % 9 == 0, F.concat("text", F.lit(" case AB-12"))).otherwise(F.col("text")).alias("value"))
    secrets = turns.where("role = 'assistant'").select(F.col("conv_id").alias("owner"), F.explode(F.split("text", r"[^\p{L}]+")).alias("term")).where("length(term) >= 8")
    return planning.sensitive_values(values, secrets)


def rebased_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as results of a conversation; each names its first two sources, and cites as many as its turn modulo three."""
    results = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("result_no"), F.concat("text", F.lit(" [Source 1] [source 2]")).alias("text"))
    cited = results.where("result_no % 3 > 0").select("run_id", "result_no", F.explode(F.sequence(F.lit(1), (F.col("result_no") % 3).cast("int"))).alias("rank"))
    return planning.rebased_answers(results, cited.withColumn("position", F.col("rank"))).select("run_id", "result_no", F.md5("text").alias("text_md5"))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: broken lines joined; and their first word without what it is wrapped in."""
    text = F.concat(F.lit("(a-\nb) \r\n\n\n\n"), "text")
    return documents(spark, sf_dir).select("doc_id", F.md5(clean_page(text)).alias("page_md5"), normalize_token(F.concat(F.lit("(“"), F.element_at(F.split("text", r"\s+"), 1), F.lit("”)."))).alias("token"))


def feedback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred events of each user as feedback; more are never listed."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("place", newest.cast("long")).where(F.col("place") <= min(100, state.page_size(500))).select("user_id", "event_id", "place")


QUERIES = {
    f.__name__: f
    for f in (
        evidence_summary, result_counts, qa_sources, result_traces, shared_terms, input_errors, batch_scores, status_report, quality_ranking, judge_averages, named_variants, audit_range,
        number_words, normalized_plans, research_plans, paper_relevance, sensitive_values, rebased_answers, clean_texts, feedback_list,
    )
}

_JUDGED = f"{retrieval._RANKED}, {retrieval._RERANKED}, j AS (SELECT query_id, doc_id, chunk_index, score, rank, score >= 0.3 AS usable, chunk_text FROM reranked JOIN (SELECT doc_id, chunk_index, chunk_text FROM c) USING (doc_id, chunk_index) WHERE rank <= {retrieval.TOP_K}), chosen AS (SELECT DISTINCT query_id, doc_id FROM sparse)"
_IDS = "coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER ({yes}), '')"
_EXCERPT = sql.strip(r"regexp_replace(chunk_text, '\s+', ' ', 'g')")
_PAGE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('(a-' || chr(10) || 'b) ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || text, '[\x00\r]', '', 'g'), '-\n([a-z])', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"

ORACLES = {
    "evidence_summary": f"""
        {_JUDGED}, used AS (SELECT DISTINCT query_id, doc_id, true AS u FROM j WHERE usable),
        s AS (SELECT query_id, count(*) AS retrieved, count(*) FILTER (usable) AS usable, {sql.fixed("min(score)")} AS least, {sql.fixed("max(score)")} AS most, {sql.fixed("avg(score)")} AS mean FROM j GROUP BY query_id)
        SELECT query_id, coalesce(retrieved, 0) AS retrieved, coalesce(usable, 0) AS usable, least, most, mean, documents, covered, missing
        FROM (SELECT query_id, count(*) AS documents, {_IDS.format(yes="u")} AS covered, {_IDS.format(yes="u IS NULL")} AS missing FROM chosen LEFT JOIN used USING (query_id, doc_id) GROUP BY query_id) LEFT JOIN s USING (query_id)
    """,
    "result_counts": f"{_JUDGED} SELECT query_id, doc_id, count(score) AS retrieved, count(*) FILTER (usable) AS usable FROM chosen LEFT JOIN j USING (query_id, doc_id) GROUP BY ALL",
    "qa_sources": f"""
        {_JUDGED} SELECT query_id, rank, doc_id, chunk_index, CASE WHEN f THEN CAST(sum(CAST(f AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) END AS citation_no, md5('[Source ' || rank || ']' || chr(10) || chunk_text) AS section
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index, substring({_EXCERPT}, 1, 220) ORDER BY rank) = 1 AS f FROM j)
    """,
    "result_traces": f"{_JUDGED} SELECT query_id, rank, doc_id, chunk_index, {sql.fixed('score')} AS score, sha256(chunk_text) AS excerpt_sha256, substring({sql.normalize_whitespace('chunk_text')}, 1, 120) AS preview FROM j",
    "shared_terms": f"""
        {retrieval._RANKED}, a AS (
            SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, term) AS place FROM (SELECT query_id, unnest({sql.terms("query")}) AS term FROM q) GROUP BY query_id, term) WHERE place <= 8
        ),
        h AS (SELECT DISTINCT query_id, doc_id, unnest({sql.term_set("text")}) AS term FROM (SELECT DISTINCT query_id, doc_id FROM sparse WHERE rank <= {retrieval.TOP_K}) JOIN documents USING (doc_id))
        SELECT query_id, term, count(*) AS documents FROM a JOIN h USING (query_id, term) GROUP BY ALL HAVING count(*) > 1
    """,
    "input_errors": f"""
        {retrieval._RANKED} SELECT query_id AS group_id, doc_id, CASE WHEN min(rank) > 3 THEN 'unselected_document' ELSE 'duplicate_document' END AS error
        FROM sparse WHERE rank <= {retrieval.TOP_K} GROUP BY ALL HAVING min(rank) > 3 OR count(*) > 1
    """,
    "batch_scores": rf"""
        {retrieval._RANKED}, w AS (
            SELECT query_id, doc_id, chunk_index, list_distinct(list_filter(regexp_split_to_array(query, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(chunk_text, '\s+'), lambda x: x <> '')) AS b
            FROM sparse JOIN c USING (doc_id, chunk_index) JOIN q USING (query_id)
        )
        SELECT query_id, doc_id, chunk_index, {sql.fixed("len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))", 6)} AS model FROM w
    """,
    "status_report": """
        SELECT unnest([1, 2, 3]) AS line_no, unnest(['# Orders', '| o_orderstatus | orders | newest |', '| --- | --- | --- |']) AS line UNION ALL
        SELECT row_number() OVER (ORDER BY o_orderstatus) + 3, '| ' || o_orderstatus || ' | ' || count(*) || ' | ' || max(o_orderkey) || ' |' FROM orders GROUP BY o_orderstatus
    """,
    "quality_ranking": f"""
        SELECT variant, quality, row_number() OVER (ORDER BY quality DESC, ms, variant) AS place FROM (
            SELECT c_mktsegment AS variant, avg(c_nationkey) AS ms, {sql.fixed("avg(CAST(c_acctbal > 0 AS INTEGER)) * 45 + avg(CAST(c_custkey % 2 = 0 AS INTEGER)) * 12.5 + avg(CAST(c_custkey % 3 = 0 AS INTEGER)) * 12.5 + avg(CAST(c_nationkey > 9 AS INTEGER)) * 10 + avg(CAST(c_acctbal > 1000 AS INTEGER)) * 15 + 5")} AS quality
            FROM customer GROUP BY c_mktsegment
        )
    """,
    "judge_averages": f"""
        SELECT route, cases, relevancy, faithfulness, row_number() OVER (ORDER BY CASE route WHEN 'qa' THEN 1 WHEN 'compare' THEN 2 WHEN 'abstain' THEN 3 ELSE 4 END, route) AS place FROM (
            SELECT CASE event_type WHEN 'view' THEN 'qa' WHEN 'click' THEN 'compare' WHEN 'error' THEN 'abstain' ELSE event_type END AS route, count(*) AS cases, {sql.fixed("avg(floor(value))")} AS relevancy,
                   {sql.fixed("avg(CASE WHEN event_id % 5 <> 0 THEN floor(value / 3) END)")} AS faithfulness FROM events GROUP BY 1
        )
    """,
    "named_variants": "SELECT * FROM (VALUES " + ", ".join(f"('{name}', {k}, {v})" for name, changes in metrics.SWEEP_VARIANTS.items() for k, v in ([(f"'{a}'", f"'{b}'") for a, b in changes.items()] or [("NULL", "NULL")])) + ") AS t(variant, setting, value)",
    "audit_range": "SELECT event_id, count(*) OVER () AS total FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'",
    "number_words": "SELECT o_orderkey AS n, o_orderkey AS english, CAST((o_orderkey % 9 + 1) * 11001 AS BIGINT) AS chinese FROM orders",
    "normalized_plans": """
        WITH t AS (SELECT conv_id AS plan_id, turn, md5(text) AS query FROM conversations WHERE turn % 3 <> 1)
        SELECT plan_id, CASE WHEN turn % 2 = 0 THEN 'q' || turn ELSE 'agent-query-' || (turn + 1) END AS query_id, CASE WHEN turn % 2 = 0 THEN 'q' || turn ELSE 'Agent query ' || (turn + 1) END AS label, query, turn = 0 AS is_primary,
               row_number() OVER (PARTITION BY plan_id ORDER BY turn) AS query_no, count(*) OVER (PARTITION BY plan_id) AS query_count, 'agent-query-planner' AS source, 'primary' AS phase,
               CASE WHEN plan_id % 2 = 0 THEN 'fact' ELSE 'unknown' END AS intent, 'default' AS profile, CASE WHEN plan_id % 7 - 1.5 >= 1 THEN CAST(floor(plan_id % 7 - 1.5) AS BIGINT) END AS top_k, nullif(plan_id % 3, 0) AS top_k_per_doc
        FROM t
    """,
    "research_plans": rf"""
        WITH u AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, regexp_replace({sql.normalize_whitespace("text")}, '[?？。.\s]+\z', '') AS topic FROM conversations WHERE role = 'user'),
        h AS (SELECT conv_id, string_agg(role || '-' || turn, ', ' ORDER BY turn) AS hints FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 4 GROUP BY conv_id),
        q AS (SELECT query_id, [{", ".join("'" + q.replace("{topic}", "' || topic || '") + "'" for q in planning.RESEARCH_QUESTIONS)}] AS asked, hints FROM u JOIN h USING (conv_id))
        SELECT query_id, 'rq-' || generate_subscripts(asked, 1) AS question_id, md5(unnest(asked) || ' Focus on these documents: ' || hints || '.') AS question FROM q
    """,
    "paper_relevance": f"""
        {retrieval._RANKED}, p AS (
            SELECT doc_id AS paper_id, query_id, list_filter({sql.terms("query")}, lambda x, i: list_position({sql.terms("query")}, x) = i)[1:12] AS w, {sql.terms("query")} AS topic, {sql.term_set("string_split(text, chr(10))[1]")} AS t, {sql.term_set("text")} AS s,
                   ' ' || {sql.normalize_search("string_split(text, chr(10))[1]")} || ' ' AS title, ' ' || {sql.normalize_search("text")} || ' ' AS body
            FROM (SELECT DISTINCT query_id, doc_id FROM sparse WHERE rank <= {retrieval.TOP_K}) JOIN documents USING (doc_id) JOIN (SELECT query_id, query FROM q) USING (query_id)
        ),
        m AS (
            SELECT paper_id, query_id, len(w) AS n, len(list_intersect(w, list_concat(t, s))) AS matched,
                   len(list_intersect(w, t)) * 2 + len(list_intersect(w, s)) + CASE WHEN len(topic) >= 2 AND (contains(title, ' ' || array_to_string(topic, ' ') || ' ') OR contains(body, ' ' || array_to_string(topic, ' ') || ' ')) THEN 3 ELSE 0 END AS score FROM p
        )
        SELECT paper_id, query_id, matched, score, n > 0 AND matched >= least(2, n) AND score >= 2.5 AS passed FROM m
    """,
    "sensitive_values": r"""
        WITH s AS (SELECT DISTINCT conv_id, lower(unnest(list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda t: length(t) >= 8))) AS term FROM conversations WHERE role = 'assistant'),
        v AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+'), lambda t: t <> ''))) AS term FROM conversations WHERE role = 'user'),
        h AS (SELECT DISTINCT conv_id, turn FROM v JOIN s USING (conv_id, term))
        SELECT c.conv_id * 1000 + c.turn AS value_id, c.conv_id % 9 = 0 OR h.turn IS NOT NULL AS sensitive FROM conversations c LEFT JOIN h USING (conv_id, turn) WHERE role = 'user'
    """,
    "rebased_answers": """
        SELECT conv_id AS run_id, turn AS result_no, md5(text || ' [Source ' || (2 * k - 1) || '] [Source ' || (2 * k) || ']') AS text_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
    """,
    "clean_texts": rf"""
        SELECT doc_id, md5({sql.strip(_PAGE)}) AS page_md5, regexp_replace(regexp_replace(lower('(“' || regexp_split_to_array(text, '\s+')[1] || '”).'), '^[^a-z0-9一-鿿]+', ''), '[^a-z0-9一-鿿]+\z', '') AS token FROM documents
    """,
    "feedback_list": "SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 100",
}
