"""Recovery evaluations of users' events and goal completion of orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.operators import recovery
from tessera.plans.tables import table

#: An event's value, rounded down, as digits; its id's remainder by twelve as the kind of trace.
_EVENTS = """
    SELECT user_id, event_id % 12 AS kind, CAST(floor(value) AS BIGINT) AS n, event_type FROM events
"""
_TRACES = """
    user_id,
    CASE WHEN kind IN (0, 1) THEN 'agent_run_recovery' WHEN kind = 2 THEN ' agent_run_step_lifecycle ' WHEN kind = 3 THEN NULL WHEN kind = 4 THEN '' WHEN kind = 5 THEN 'agent_run_step_replay'
         WHEN kind IN (6, 7, 8) THEN 'agent_task_recovery' WHEN kind = 9 THEN 'agent' ELSE 'other' END AS trace_type,
    CASE kind WHEN 0 THEN 'startup_recovery_completed' WHEN 1 THEN 'manual_recovery_action' WHEN 2 THEN 'step_started' WHEN 3 THEN 'step_completed' WHEN 4 THEN 'step_failed' WHEN 6 THEN 'task_recovery_scheduled'
         WHEN 7 THEN 'task_recovery_run' WHEN 8 THEN 'task_resume_action' WHEN 9 THEN 'planner' WHEN 10 THEN 'step_started' END AS event_type,
    CASE WHEN kind = 1 THEN CASE n % 3 WHEN 0 THEN 'resume_from_step' WHEN 1 THEN 'retry_failed_step' ELSE 'cancel' END WHEN kind = 5 THEN CASE n % 2 WHEN 0 THEN 'retry_step' ELSE 'resume_step' END END AS action,
    CASE WHEN kind = 9 AND event_type = 'error' AND n % 7 = 0 THEN 'fallback' WHEN event_type = 'error' AND n % 5 = 0 THEN 'failed' WHEN event_type = 'purchase' THEN 'completed' END AS status,
    CASE WHEN kind = 7 AND n % 2 = 0 THEN 'completed' END AS result_status, CASE WHEN event_type = 'view' AND n % 6 = 0 THEN 'timeout' END AS error,
    CASE WHEN n % 2 = 0 THEN 'document_rag:primary' ELSE 'document_rag:2' END AS step_id, CASE WHEN n % 4 = 1 THEN ' Primary ' END AS phase,
    n % 4 AS recoverable, CASE WHEN n % 4 = 3 THEN -1 ELSE n % 3 END AS manual, n % 5 AS attempts, CASE WHEN n % 5 > 0 AND n % 11 = 0 THEN n % 5 - 1 ELSE n % 5 END AS successes,
    CASE WHEN n % 5 > 0 AND n % 11 = 0 THEN 1 ELSE 0 END AS failures, CASE WHEN n % 2 = 0 THEN n % 3 END AS scheduled, n % 4 AS refs
"""
BY = ("user_id",)


def recovery_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the traces of one evaluation: starts, actions, steps, replays, tasks, plans."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 12).alias("kind"), F.floor("value").alias("n"), "event_type")
    return rows.selectExpr(*_split(_TRACES))


def _split(columns: str) -> list[str]:
    """Column expressions between the commas outside parentheses."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(columns[at:i])
            at = i + 1
    return [*parts, columns[at:]]


def recovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery_stats(recovery_traces(spark, sf_dir), BY)


def recovery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery_checks(recovery_stats(spark, sf_dir), BY)


def recovery_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery_summary(recovery_checks(spark, sf_dir), BY)


def _goals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as tasks, their lines as steps, deliverables (two a line at most) and research phases."""
    k = F.col("o_orderkey")
    texts = lambda *xs: F.array(*map(F.lit, xs))
    status = F.when(k % 13 == 0, "queued").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "running").when(k % 3 == 0, "failed").when(k % 3 == 1, "waiting_for_user").otherwise("pending")
    tasks = table(spark, sf_dir, "orders").select(
        k.alias("task_id"), status.alias("status"), F.when(k % 17 == 0, "budget").when(k % 2 == 0, "completed").alias("stopped_reason"), F.when(k % 19 == 0, " ").when(k % 11 == 0, "approve").alias("required_action"),
        (k % 23 == 0).alias("pending"), F.when(k % 5 == 0, 1).cast("long").alias("unresolved_gaps"), (F.when(k % 7 == 0, 2).otherwise(0)).cast("long").alias("unsupported_claims"),
        F.when(k % 29 == 0, "waiting_for_approval").otherwise("completed").alias("deliverable_status"), F.when(k % 4 == 0, "completed").when(k % 4 == 1, "running").alias("research_status"),
        F.lit("research").alias("workflow_id"), F.when(k % 6 != 0, "1.0.0").alias("workflow_version"), F.when(k % 8 == 0, "").otherwise("search").alias("workflow_phase"), F.when(k % 16 == 0, "completed").alias("workflow_status"),
        F.when(k % 9 == 0, texts("a", " ")).otherwise(texts("a", "b")).alias("workflow_checks"), F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(texts("summary.create")).alias("workflow_capabilities"),
    )
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey")
    done = F.when((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 31 != 0), "completed").otherwise("pending")
    capability = F.when(F.col("l_linenumber") == 1, "summary.create").when(F.col("l_linenumber") == 2, "report.export").otherwise("other")
    planned = lines.where("l_linenumber <= 2").select("task_id", F.lit("planned").alias("part"), capability.alias("capability"), F.lit("completed").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("artifact_id", "artifact_type", "artifact_status")])
    results = lines.where("l_linenumber <= 2 AND task_id % 37 <> 0").select(
        "task_id", F.lit("result").alias("part"), capability.alias("capability"), F.when(F.col("l_suppkey") % 11 == 0, "failed").otherwise("completed").alias("status"), F.lit("artifact").alias("artifact_id"),
        F.when(F.col("l_suppkey") % 13 == 0, "report").when(F.col("l_linenumber") == 1, "summary").otherwise("report").alias("artifact_type"), F.when(F.col("l_returnflag") == "R", "archived").otherwise("active").alias("artifact_status"),
    )
    return tasks, lines.select("task_id", done.alias("status")), planned.unionByName(results), lines.select("task_id", F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending").alias("status"))


def goal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.goal_checks(*_goals(spark, sf_dir))


def goal_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = _goals(spark, sf_dir)
    return recovery.goal_completion(recovery.goal_checks(*goals), goals[0])


QUERIES = {f.__name__: f for f in (recovery_stats, recovery_checks, recovery_evaluation, goal_checks, goal_completion)}

_STARTUP = "trace = 'agent_run_recovery' AND event = 'startup_recovery_completed'"
_MANUAL = "trace = 'agent_run_recovery' AND event = 'manual_recovery_action'"
_REPLAY = "trace = 'agent_run_step_replay'"
_RESUME = "trace = 'agent_task_recovery' AND event = 'task_resume_action'"
_STEP = "trace IN ('', 'agent_run_step_lifecycle') AND event IN ('step_started', 'step_completed', 'step_failed')"
_PRIMARY = f"{_STEP} AND (step_id LIKE '%:primary' OR lower(trim(coalesce(phase, ''))) = 'primary')"
_FAILED = "(coalesce(status, '') = 'failed' OR error IS NOT NULL)"
_COUNTERS = {
    **{name: f"CAST(coalesce(sum(greatest({c}, 0)) FILTER ({_STARTUP}), 0) AS BIGINT)" for name, c in (("recoverable_runs", "recoverable"), ("manual_recoveries", "manual"), ("auto_replays", "attempts"), ("auto_replay_successes", "successes"), ("auto_replay_failures", "failures"))},
    "step_events": f"count(*) FILTER ({_STEP})",
    **{name: f"count(*) FILTER ({_PRIMARY} AND event = '{kind}')" for name, kind in recovery.STEP_EVENTS.items()},
    "manual_actions": f"count(*) FILTER ({_MANUAL})",
    **{name: f"count(*) FILTER ({_MANUAL} AND action = '{kind}')" for name, kind in (("resume_actions", "resume_from_step"), ("retry_actions", "retry_failed_step"), ("cancel_actions", "cancel"))},
    "manual_action_failures": f"count(*) FILTER ({_MANUAL} AND {_FAILED})",
    "step_retries": f"count(*) FILTER ({_REPLAY} AND action = 'retry_step')", "step_resumes": f"count(*) FILTER ({_REPLAY} AND action = 'resume_step')", "step_replay_failures": f"count(*) FILTER ({_REPLAY} AND {_FAILED})",
    "task_scheduled": "CAST(coalesce(sum(coalesce(scheduled, refs)) FILTER (trace = 'agent_task_recovery' AND event = 'task_recovery_scheduled'), 0) AS BIGINT)",
    "task_completed": "count(*) FILTER (trace = 'agent_task_recovery' AND event = 'task_recovery_run' AND (result_status = 'completed' OR status = 'completed'))",
    "task_resumes": f"count(*) FILTER ({_RESUME})", "task_resume_failures": f"count(*) FILTER ({_RESUME} AND {_FAILED})", "planner_fallbacks": "count(*) FILTER (trace = 'agent' AND event = 'planner' AND status = 'fallback')",
}
_STATS = f"""
    t AS (SELECT *, trim(coalesce(trace_type, '')) AS trace, coalesce(event_type, '') AS event FROM (SELECT {_TRACES} FROM ({_EVENTS}))),
    s AS (SELECT user_id, {", ".join(f"{x} AS {name}" for name, x in _COUNTERS.items())} FROM t GROUP BY user_id),
    stats AS (SELECT *, CASE WHEN auto_replays > 0 THEN {sql.fixed("auto_replay_successes / auto_replays")} ELSE 0.0 END AS auto_replay_rate, least(task_scheduled, task_completed) AS task_recoveries FROM s)
"""
_BOUND = {"some": ">= 1", "none": "= 0", "one": "= 1"}
_CHECKS = "checks AS (" + " UNION ALL ".join(
    f'SELECT user_id, \'{case}\' AS "case", CAST({n} AS INTEGER) AS check_no, \'{check}\' AS "check", \'{category}\' AS category, {counter} {_BOUND[kind]} AS passed FROM stats'
    for case, checks in recovery.CASES.items() for n, (check, category, counter, kind) in enumerate(checks)
) + ")"
_RATES = ", ".join(sql.fixed(f"count(*) FILTER (category = '{c}' AND passed) / count(*) FILTER (category = '{c}')") + f" AS {c}_rate" for c in recovery.CATEGORIES)
_TASKS = """
    tasks AS (
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'queued' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 3 = 0 THEN 'failed'
               WHEN o_orderkey % 3 = 1 THEN 'waiting_for_user' ELSE 'pending' END AS status FROM orders
    ),
    lines AS (
        SELECT l_orderkey AS k, count(*) AS steps, count(*) FILTER (l_linestatus = 'F' AND l_suppkey % 31 <> 0) AS steps_done, count(*) FILTER (l_linestatus = 'F') AS phases_done, count(*) FILTER (l_linenumber <= 2) AS planned,
               count(*) FILTER (l_linenumber <= 2 AND l_suppkey % 11 = 0) AS undelivered, count(*) FILTER (l_linenumber = 1 AND l_suppkey % 13 = 0) AS mistyped
        FROM lineitem GROUP BY l_orderkey
    ),
    facts AS (
        SELECT k, status, status = 'completed' AND (k % 17 <> 0) AS a, status = 'completed' AND coalesce(steps, 0) > 0 AND steps = steps_done AS b, k % 5 <> 0 AND k % 7 <> 0 AS c,
               coalesce(planned, 0) = 0 OR (k % 29 <> 0 AND k % 37 <> 0 AND undelivered = 0 AND mistyped = 0) AS d, (k % 11 <> 0 OR k % 19 = 0) AND k % 23 <> 0 AND k % 29 <> 0 AS e,
               k % 4 > 1 OR (k % 4 = 0 AND coalesce(steps, 0) > 0 AND phases_done = steps) AS f, k % 4 > 1 OR (k % 6 <> 0 AND k % 9 <> 0 AND k % 10 <> 0 AND (k % 8 <> 0 OR k % 16 = 0)) AS g
        FROM tasks LEFT JOIN lines USING (k)
    ),
    goals AS (
        SELECT k AS task_id, status, unnest(generate_series(0, 6)) AS n, unnest([a, b, c, d, e, f, g]) AS ok FROM facts
    ),
    goal_checks AS (SELECT task_id, status, CAST(n AS INTEGER) AS check_no, [{names}][n + 1] AS "check", coalesce(ok, false) AS passed FROM goals)
""".replace("{names}", sql.quoted(recovery.GOAL_CHECKS))

ORACLES = {
    "recovery_stats": f"WITH {_STATS} SELECT * FROM stats",
    "recovery_checks": f"WITH {_STATS}, {_CHECKS} SELECT * FROM checks",
    "recovery_evaluation": f"""
        WITH {_STATS}, {_CHECKS}, w AS (SELECT user_id, count(*) AS cases, count(*) FILTER (whole) AS passed_cases FROM (SELECT user_id, bool_and(passed) AS whole FROM checks GROUP BY user_id, "case") GROUP BY user_id)
        SELECT user_id, any_value(w.cases) AS cases, any_value(w.passed_cases) AS passed_cases, count(*) AS checks, count(*) FILTER (passed) AS passed_checks, {_RATES}, CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS status
        FROM checks JOIN w USING (user_id) GROUP BY user_id
    """,
    "goal_checks": f'WITH {_TASKS} SELECT task_id, check_no, "check", passed FROM goal_checks',
    "goal_completion": f"""
        WITH {_TASKS}, o AS (SELECT task_id, any_value(status) AS status, count(*) FILTER (NOT passed) AS n, coalesce(string_agg("check", ',' ORDER BY check_no) FILTER (NOT passed), '') AS blockers FROM goal_checks GROUP BY task_id),
        c AS (SELECT *, CASE WHEN n = 0 THEN 'completed' WHEN status = 'failed' THEN 'failed' WHEN status IN ('queued', 'running') THEN 'running' WHEN status = 'waiting_for_user' THEN 'pending' ELSE 'blocked' END AS completion FROM o)
        SELECT task_id, completion, blockers, CASE completion WHEN 'completed' THEN 'Goal completion checks passed.' WHEN 'running' THEN 'Goal completion checks are still running.' WHEN 'pending' THEN 'Goal completion checks are waiting for user action.'
               WHEN 'failed' THEN 'Goal completion checks failed.' ELSE 'Goal completion is blocked by ' || n || CASE WHEN n = 1 THEN ' check.' ELSE ' checks.' END END AS summary FROM c
    """,
}
