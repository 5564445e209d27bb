"""Telemetry, gates and stores over events, orders, conversations and documents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.scores import fixed, token_cost, token_estimate
from tessera.operators import gates, metrics, state, telemetry
from tessera.plans.tables import CALLS_SQL, calls, documents, table
from tessera.streaming import rollups

NOW = "2024-01-20 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def llmops_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.llmops_rollup(calls(spark, sf_dir))


def rag_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces: the type as route mode, errors as abstentions, the user's last digit as citations."""
    rows = calls(spark, sf_dir).select(F.col("operation").alias("mode"), "latency_ms", (F.col("user_id") % 10).alias("citations"), (F.col("status") == "error").alias("abstained"))
    return telemetry.rag_rollup(rows)


def slo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by route and service level; limits depend on the user, and some have none."""
    limit = F.when(F.col("user_id") % 7 == 0, None).otherwise(F.lit(40) + F.col("user_id") % 20)
    return calls(spark, sf_dir).groupBy("route", gates.slo_status(F.col("latency_ms"), limit).alias("level")).agg(F.count(F.lit(1)).alias("calls"))


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of each user against a token budget that odd users lack."""
    spent = calls(spark, sf_dir).groupBy("user_id").agg(F.sum("tokens").alias("tokens"), fixed(F.sum("cost"), 6).alias("cost"), fixed(F.max("latency_ms"), 3).alias("slowest"))
    limit = F.when(F.col("user_id") % 2 == 0, F.lit(8000).cast("long"))
    alerts = gates.budget_alerts(F.col("tokens"), limit, F.col("cost"), F.lit(0.02), F.col("slowest"), F.lit(200.0))
    return spent.select("user_id", "tokens", "cost", gates.budget_status(F.col("tokens"), limit).alias("budget"), F.array_join(alerts, ",").alias("alerts"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(calls(spark, sf_dir), ("operation",), "latency_ms")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation, nations without one included."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("status"))
    return telemetry.status_counts(table(spark, sf_dir, "supplier"), nations, "s_nationkey")


def planner_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plans: the clerkless status as planner, urgent ones fall back, priority as reason."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("planner"), (~F.col("o_orderpriority").startswith("1")).alias("fallback"), F.col("o_orderpriority").alias("reason"))
    return telemetry.planner_rollup(rows).withColumn("reason_rank", F.col("reason_rank").cast("long"))


def skill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.skill_rollup(calls(spark, sf_dir).select(F.col("route").alias("skill"), "status"))


def conditional_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates of documents by language."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    rates = {"quality_rate": ("quality = 1", "quality IS NOT NULL"), "toxic_if_good": ("toxic = 1", "quality = 1"), "good_if_src0": ("quality = 1", "source = 'src0'")}
    return telemetry.conditional_rates(rows, rates, ("lang",))


def feedback_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents as failed feedback of their source."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("skill"), F.col("doc_id").alias("feedback_id"), F.col("lang").alias("kind"))
    return telemetry.feedback_failures(rows)


def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and cost of each conversation's turns, users asking and others answering."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("role") == "user", token_estimate(F.length("text")).alias("n")).toDF("conv_id", "asks", "n")
    sums = turns.groupBy("conv_id").agg(F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).cast("long").alias("tokens_in"), F.sum(F.when(F.col("asks"), 0).otherwise(F.col("n"))).cast("long").alias("tokens_out"))
    return sums.withColumn("cost", fixed(token_cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(2.5), F.lit(10.0)), 8))


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates of the first half of the documents against those of the second."""
    rows = table(spark, sf_dir, "labels").withColumn("half", F.col("doc_id") % 2)
    one = lambda k: rows.where(F.col("half") == k).agg(fixed(F.avg("quality")).alias("ndcg"), fixed(F.avg("toxic")).alias("recall"), fixed(F.avg(F.col("quality") * F.col("toxic"))).alias("mrr"), F.lit(None).cast("double").alias("precision"))
    return gates.regression_gate(one(0), one(1))


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.worst_status(regression_gate(spark, sf_dir))


def latest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as quality runs: customer segment as profile, clerk priority as corpus, finished ones passed."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = rows.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created"), F.col("c_mktsegment").alias("profile"), F.col("o_orderpriority").alias("corpus"), (F.col("o_orderstatus") == "F").alias("passed"))
    return gates.latest_baseline(runs, runs.where("NOT passed"))


def session_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent_messages(table(spark, sf_dir, "conversations"))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to delete: all but the newest 40 of each user."""
    return state.prune(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ("user_id",), 40, "ts", "event_id").select("event_id", "user_id")


def claimable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks: purchases are queued, clicks run under a lease of so many minutes as their value."""
    status = F.when(F.col("event_type") == "purchase", "queued").when(F.col("event_type") == "click", "running").otherwise("completed")
    lease = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    tasks = table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").alias("due_at"), lease.alias("lease_until"), (F.col("user_id") % 3).alias("attempt"))
    return state.claimable(tasks, at(NOW))


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks, as in claimable_tasks."""
    status = F.when(F.col("event_type") == "purchase", "queued").when(F.col("event_type") == "click", "running").otherwise("completed")
    lease = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), status.alias("status"), F.col("ts").alias("due_at"), lease.alias("lease_until"))


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.claim_states(event_tasks(spark, sf_dir), at(NOW))


def audit_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the ten days before NOW and later."""
    return state.retained(table(spark, sf_dir, "events").select("event_id", "ts"), at(NOW), 10, "ts").select("event_id")


def expired_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as uploads: those without an event in the 24 hours before the last day's end."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("upload_id"), F.col("ts").alias("modified"))
    return state.expired_uploads(rows, at("2024-01-31 00:00:00"))


def recovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of a user's recovery."""
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "recovery_started", "purchase", "recovery_completed", "error", "recovery_failed", "click", "step_replayed", "view", "other")]), F.col("event_type"))
    return telemetry.recovery_counters(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), named.alias("type")))


def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates against fixed bounds."""
    row = table(spark, sf_dir, "labels").agg(fixed(F.avg("quality")).alias("quality"), fixed(F.avg("toxic")).alias("toxic"), F.lit(None).cast("double").alias("unknown_rate"))
    return gates.threshold_gate(row, [("quality", "min", 0.99, "fail"), ("toxic", "max", 0.05, "warn"), ("quality", "max", 1.0, "fail"), ("unknown_rate", "max", 0.1, "fail")])


def memory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns, with what a user may ask to be kept put before every tenth."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit("Remember that "), "text")).when(F.col("conv_id") % 10 == 1, F.concat(F.lit("Answer in English and keep it short. "), "text")).otherwise(F.col("text"))
    return state.memory_candidates(turns.select(F.col("conv_id").alias("owner"), F.col("turn").alias("message_id"), text.alias("text")))


def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the states of a run."""
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "queued", "view", "running", "click", "paused", "purchase", "completed", "error", "failed")]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), named.alias("status"))
    return state.illegal_transitions(rows)


def scoped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of source src1, shared ones in French, and those of src0, which belong to all."""
    owner = F.when(F.col("source") != "src0", F.col("source"))
    rows = documents(spark, sf_dir).select("doc_id", owner.alias("owner"), F.col("lang").alias("workspace"))
    return rows.where(state.in_scope("src1", "fr"))


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 error events, newest first, with their total."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return state.audit_page(rows, 2, 25, [F.desc("ts"), F.desc("event_id")], event_type="error", user_id=None).select("event_id", "user_id", "total")


def audit_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 error events that follow, newest first, the newest event of the tenth of January or before."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    last = rows.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    return state.audit_after(rows, last, 40, id_col="event_id", event_type="error").select("event_id", "user_id")


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return state.latest_snapshot(rows, ("user_id", "event_type"), ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' first orders arrive as artifacts; those of customers below 500 exist."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("artifact"))
    existing = table(spark, sf_dir, "customer").where("c_custkey < 500").select(F.col("c_custkey").alias("key"))
    return state.insert_new(existing, orders, "key")


def merge_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as uploads in parts; those whose id ends in 7 lack their last part."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("part"), F.col("text").alias("body"))
    totals = turns.groupBy("upload_id").agg(F.count(F.lit(1)).alias("total"))
    parts = turns.join(totals, "upload_id").where("NOT (upload_id % 10 = 7 AND part = total - 1)")
    return state.merge_uploads(parts)


def rank_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns as preferences, others as notes of the conversation."""
    notes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("note_id"), F.when(F.col("role") == "system", "preference").otherwise("note").alias("kind"), "text")
    ranked = state.rank_memories(notes, "the answer of an and that translation list summary explain question", 3)
    return ranked.select("owner", "note_id", fixed(F.col("weight")).alias("weight"), F.col("place").cast("long").alias("place"))


def resolve_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as workspaces, regions as operations, parts' brands as models in order of size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wanted = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("workspace"), F.col("r_name").alias("operation"), "n_nationkey")
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("position")).select(F.col("p_brand").alias("model"), "position")
    candidates = region.select(F.col("r_name").alias("operation"), "r_regionkey").join(brands, F.col("position") % 5 == F.col("r_regionkey")).select("operation", "position", "model")
    blocked = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("Brand#11"), F.lit("Brand#22"), F.lit("Brand#33"))).otherwise(F.array().cast("array<string>"))
    allowed = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("Brand#12"), F.lit("Brand#44"))).otherwise(F.array().cast("array<string>"))
    policy = wanted.select("workspace", blocked.alias("blocked"), allowed.alias("allowed"))
    return state.resolve_routes(wanted.select("workspace", "operation"), candidates, policy)


def stream_to_table(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """All that a bounded stream gives, by one run over what is there."""
    import uuid

    name = f"stream_{uuid.uuid4().hex}"
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; its times are taken as UTC."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.select("user_id", "event_type", "value", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("ts"))


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_to_table(spark, rollups.windowed_rollup(event_stream(spark, sf_dir)).drop("users"), "complete")
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts")
    return rollups.sessions_by_gap(rows).select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), "events")


QUERIES = {
    f.__name__: f
    for f in (
        llmops_rollup, rag_rollup, slo_status, budget_status, latency_percentiles, status_counts, planner_rollup, skill_rollup, conditional_rates, feedback_failures, token_costs,
        regression_gate, gate_verdict, latest_baseline, session_recent, retention_prune, claimable_tasks, illegal_transitions, scoped_documents, audit_page, audit_after, latest_snapshot, insert_new,
        merge_uploads, rank_memories, resolve_routes, stream_rollup, session_windows, task_states, audit_retained, expired_uploads, recovery_counters, threshold_gate, memory_candidates,
    )
}

_SUMS = f"""
    count(*) AS calls, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (slo = 'breach') AS breaches,
    {sql.fixed("count(*) FILTER (status = 'error') / count(*)")} AS error_rate, {sql.fixed("avg(latency_ms)", 3)} AS mean_latency, CAST(sum(tokens) AS BIGINT) AS tokens, {sql.fixed("sum(cost)", 4)} AS cost
"""
_HALF = "SELECT {f1} AS ndcg, {f2} AS recall, {f3} AS mrr FROM labels WHERE doc_id % 2 = {k}"
_half = functools.partial(_HALF.format, f1=sql.fixed("avg(quality)"), f2=sql.fixed("avg(toxic)"), f3=sql.fixed("avg(quality * toxic)"))
_GATE = f"""
    SELECT metric, before, after, CASE WHEN d IS NULL THEN 'unknown' WHEN d <= -f THEN 'fail' WHEN d <= -w THEN 'warn' ELSE 'pass' END AS status FROM (
        SELECT *, round((after - before) * 10000) / 10000 AS d FROM (
            SELECT 'ndcg' AS metric, b.ndcg AS before, a.ndcg AS after, 0.01 AS w, 0.03 AS f FROM ({_half(k=0)}) b, ({_half(k=1)}) a
            UNION ALL SELECT 'recall', b.recall, a.recall, 0.01, 0.03 FROM ({_half(k=0)}) b, ({_half(k=1)}) a
            UNION ALL SELECT 'mrr', b.mrr, a.mrr, 0.01, 0.03 FROM ({_half(k=0)}) b, ({_half(k=1)}) a
            UNION ALL SELECT 'precision', NULL, NULL, 0.02, 0.05
        )
    )
"""
_RUNS = "SELECT o_orderkey AS run_id, o_orderdate AS created, c_mktsegment AS profile, o_orderpriority AS corpus, o_orderstatus = 'F' AS passed FROM orders JOIN customer ON o_custkey = c_custkey"
_MAP = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'paused' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
_LEGAL = " OR ".join(f"(previous = '{a}' AND status = '{b}')" for a, bs in state.TRANSITIONS.items() for b in bs)
_NOTE_TERMS = "['answer', 'translation', 'list', 'summary', 'explain', 'question']"

ORACLES = {
    "llmops_rollup": f"""
        WITH c AS ({CALLS_SQL})
        SELECT 'all' AS grain, '' AS name, {_SUMS} FROM c
        UNION ALL SELECT 'operation', operation, {_SUMS} FROM c GROUP BY operation
        UNION ALL SELECT 'route', route, {_SUMS} FROM c GROUP BY route
    """,
    "rag_rollup": f"""
        SELECT operation AS mode, count(*) AS traces, {sql.fixed("avg(latency_ms)", 3)} AS mean_latency, {sql.fixed("avg(user_id % 10)")} AS mean_citations,
               {sql.fixed("count(*) FILTER (status = 'error') / count(*)")} AS abstain_rate FROM ({CALLS_SQL}) GROUP BY operation
    """,
    "slo_status": f"""
        SELECT route, CASE WHEN user_id % 7 = 0 OR latency_ms IS NULL OR latency_ms < 0 THEN 'unavailable' WHEN latency_ms <= 40 + user_id % 20 THEN 'pass' ELSE 'breach' END AS level, count(*) AS calls
        FROM ({CALLS_SQL}) GROUP BY ALL
    """,
    "budget_status": f"""
        SELECT user_id, tokens, cost, CASE WHEN user_id % 2 = 1 THEN 'unavailable' WHEN tokens > 8000 THEN 'exceeded' ELSE 'ok' END AS budget,
               concat_ws(',', CASE WHEN user_id % 2 = 0 AND tokens > 8000 THEN 'token_budget' END, CASE WHEN cost > 0.02 THEN 'cost_budget' END, CASE WHEN slowest > 200 THEN 'latency_slo' END) AS alerts
        FROM (SELECT user_id, CAST(sum(tokens) AS BIGINT) AS tokens, {sql.fixed("sum(cost)", 6)} AS cost, {sql.fixed("max(latency_ms)", 3)} AS slowest FROM ({CALLS_SQL}) GROUP BY user_id)
    """,
    "latency_percentiles": f"""
        SELECT event_type AS operation, count(value) AS n, {sql.fixed("min(value)", 3)} AS least, {sql.fixed("max(value)", 3)} AS most, {sql.fixed("avg(value)", 3)} AS mean,
               {", ".join(f"{sql.fixed(f'quantile_disc(value, {q})', 3)} AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))}
        FROM events GROUP BY event_type
    """,
    "status_counts": "SELECT n_nationkey AS status, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey",
    "planner_rollup": f"""
        SELECT planner, reason_rank, reason, n, fallback_rate FROM (
            SELECT o_orderstatus AS planner, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS reason_rank, o_orderpriority AS reason, count(*) AS n
            FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY o_orderstatus, o_orderpriority
        ) JOIN (SELECT o_orderstatus AS planner, {sql.fixed("count(*) FILTER (o_orderpriority NOT LIKE '1%') / count(*)")} AS fallback_rate FROM orders GROUP BY o_orderstatus) USING (planner)
        WHERE reason_rank <= 5
    """,
    "skill_rollup": f"""
        SELECT route AS skill, count(*) AS attempts, count(*) FILTER (status = 'ok') AS successes, count(*) FILTER (status = 'error') AS failures, {sql.fixed("count(*) FILTER (status = 'ok') / count(*)")} AS success_rate
        FROM ({CALLS_SQL}) GROUP BY route
    """,
    "conditional_rates": f"""
        SELECT lang, {sql.fixed("count(*) FILTER (quality = 1) / nullif(count(quality), 0)")} AS quality_rate, {sql.fixed("count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0)")} AS toxic_if_good,
               {sql.fixed("count(*) FILTER (source = 'src0' AND quality = 1) / nullif(count(*) FILTER (source = 'src0'), 0)")} AS good_if_src0
        FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """,
    "feedback_failures": """
        SELECT skill, count(*) AS failures, count(DISTINCT kind) AS kinds, array_to_string(list_transform(list_sort(list(feedback_id))[1:12], lambda i: CAST(i AS VARCHAR)), ',') AS examples
        FROM (SELECT source AS skill, doc_id AS feedback_id, lang AS kind FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY skill
    """,
    "token_costs": f"""
        SELECT conv_id, tokens_in, tokens_out, {sql.fixed("tokens_in / 1e6 * 2.5 + tokens_out / 1e6 * 10.0", 8)} AS cost FROM (
            SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE n END) AS BIGINT) AS tokens_out
            FROM (SELECT conv_id, role, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END AS n FROM conversations) GROUP BY conv_id
        )
    """,
    "regression_gate": _GATE,
    "gate_verdict": f"SELECT CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status FROM ({_GATE})",
    "latest_baseline": f"""
        WITH r AS ({_RUNS}), good AS (SELECT * FROM r WHERE passed),
        a AS (
            SELECT w.run_id,
                   max_by(g.run_id, (g.created, g.run_id)) FILTER (g.profile = w.profile AND g.corpus = w.corpus) AS same,
                   max_by(g.run_id, (g.created, g.run_id)) FILTER (g.corpus = w.corpus) AS by_corpus,
                   max_by(g.run_id, (g.created, g.run_id)) FILTER (g.profile = w.profile) AS by_profile
            FROM (SELECT * FROM r WHERE NOT passed) w LEFT JOIN good g ON g.created < w.created AND (g.profile = w.profile OR g.corpus = w.corpus) GROUP BY w.run_id
        )
        SELECT run_id, coalesce(same, by_corpus, by_profile) AS baseline_id,
               CASE WHEN same IS NOT NULL THEN 'profile_and_corpus' WHEN by_corpus IS NOT NULL THEN 'corpus' WHEN by_profile IS NOT NULL THEN 'profile' ELSE 'none' END AS strategy FROM a
    """,
    "session_recent": """
        SELECT conv_id, turn, role, substring(text, 1, CASE WHEN role = 'user' THEN 400 ELSE 700 END) AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 6
    """,
    "retention_prune": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age > 40",
    "claimable_tasks": f"""
        SELECT event_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'queued' ELSE 'expired' END AS why, user_id % 3 + 1 AS attempt FROM events
        WHERE (event_type = 'purchase' AND ts <= TIMESTAMP '{NOW}') OR (event_type = 'click' AND ts + to_minutes(CAST(floor(value) AS INTEGER)) <= TIMESTAMP '{NOW}')
    """,
    "illegal_transitions": f"""
        SELECT run_id, seq, previous, status FROM (
            SELECT user_id AS run_id, event_id AS seq, {_MAP} AS status, lag({_MAP}) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events
        ) WHERE previous IS NOT NULL AND previous <> status AND NOT ({_LEGAL})
    """,
    "scoped_documents": """
        SELECT doc_id, CASE WHEN source <> 'src0' THEN source END AS owner, lang AS workspace FROM documents WHERE source IN ('src0', 'src1') OR lang = 'fr'
    """,
    "audit_after": """
        SELECT event_id, user_id FROM events WHERE event_type = 'error' AND (ts, event_id) < (SELECT max((ts, event_id)) FROM events WHERE ts < TIMESTAMP '2024-01-11') ORDER BY ts DESC, event_id DESC LIMIT 40
    """,
    "audit_page": """
        SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50
    """,
    "latest_snapshot": "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "insert_new": "SELECT o_custkey AS key, min(o_orderkey) AS artifact FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey < 500) GROUP BY o_custkey",
    "merge_uploads": """
        WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations), p AS (SELECT * FROM t WHERE NOT (conv_id % 10 = 7 AND turn = total - 1))
        SELECT conv_id AS upload_id, count(*) = any_value(total) AND max(turn) + 1 = any_value(total) AS complete, count(*) AS parts,
               CASE WHEN count(*) = any_value(total) AND max(turn) + 1 = any_value(total) THEN strlen(string_agg(text, '' ORDER BY turn)) END AS bytes,
               CASE WHEN count(*) = any_value(total) AND max(turn) + 1 = any_value(total) THEN sha256(string_agg(text, '' ORDER BY turn)) END AS sha256
        FROM p GROUP BY conv_id
    """,
    "rank_memories": f"""
        SELECT owner, note_id, weight, place FROM (
            SELECT *, row_number() OVER (PARTITION BY owner ORDER BY weight DESC, note_id) AS place FROM (
                SELECT conv_id AS owner, turn AS note_id, CASE WHEN role = 'system' THEN 100.0 ELSE CAST(len(list_intersect({_NOTE_TERMS}, {sql.term_set("text")})) AS DOUBLE) END AS weight FROM conversations
            ) WHERE weight > 0
        ) WHERE place <= 3
    """,
    "resolve_routes": """
        WITH m AS (SELECT p_brand AS model, min(p_partkey) AS position FROM part GROUP BY p_brand),
        x AS (
            SELECT n_name AS workspace, r_name AS operation, model, position,
                   model IS NOT NULL AND NOT (n_nationkey % 3 = 0 AND model IN ('Brand#11', 'Brand#22', 'Brand#33')) AND (n_nationkey % 4 <> 0 OR model IN ('Brand#12', 'Brand#44')) AS ok
            FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN m ON position % 5 = r_regionkey
        )
        SELECT workspace, operation, min_by(model, position) FILTER (ok) AS model, CASE WHEN bool_or(ok) THEN 'selected' WHEN count(model) > 0 THEN 'blocked' ELSE 'not_found' END AS status,
               count(*) FILTER (model IS NOT NULL AND NOT ok) AS rejected FROM x GROUP BY workspace, operation
    """,
    "stream_rollup": f"SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS events, {sql.fixed('avg(value)')} AS mean_value FROM events GROUP BY 1, 2",
    "session_windows": """
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS events FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
                SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events
            )
        ) GROUP BY user_id, session
    """,
    "task_states": f"""
        SELECT event_id AS task_id, CASE WHEN wait IS NULL THEN 'done' WHEN wait = 0 THEN 'claimable' WHEN event_type = 'purchase' THEN 'waiting' ELSE 'leased' END AS state, wait AS wait_ms FROM (
            SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'click') THEN CAST(greatest(0, ceil((epoch_us(CASE WHEN event_type = 'purchase' THEN ts ELSE ts + to_minutes(CAST(floor(value) AS INTEGER)) END) - epoch_us(TIMESTAMP '{NOW}')) / 1000)) AS BIGINT) END AS wait FROM events
        )
    """,
    "audit_retained": f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY",
    "expired_uploads": "SELECT user_id AS upload_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR",
    "recovery_counters": f"""
        SELECT count(DISTINCT user_id) AS runs, count(*) FILTER (event_type = 'signup') AS recoveries, count(*) FILTER (event_type = 'purchase') AS recovered,
               count(*) FILTER (event_type = 'error') AS failed_recoveries, CAST(0 AS BIGINT) AS manual, count(*) FILTER (event_type = 'click') AS replays,
               {sql.fixed("count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'signup'), 0)")} AS recovery_rate FROM events
    """,
    "threshold_gate": f"""
        WITH r AS (SELECT {sql.fixed("avg(quality)")} AS q, {sql.fixed("avg(toxic)")} AS t FROM labels)
        SELECT 'quality' AS metric, q AS value, CASE WHEN q < 0.99 THEN 'fail' ELSE 'pass' END AS status FROM r
        UNION ALL SELECT 'toxic', t, CASE WHEN t > 0.05 THEN 'warn' ELSE 'pass' END FROM r
        UNION ALL SELECT 'quality', q, CASE WHEN q > 1 THEN 'fail' ELSE 'pass' END FROM r
        UNION ALL SELECT 'unknown_rate', NULL, 'unknown'
    """,
}
