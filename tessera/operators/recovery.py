"""Recovery of runs: counters of trace events by group, the cases they must meet, and goal completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import fixed

# The cases of a recovery evaluation, each with its checks: name, category, counter, and
# what the counter must be.
CASES = {
    "startup_recovery_summary": [
        ("recoverable_runs_recorded", "coverage", "recoverable_runs", "some"),
        ("manual_recovery_required", "coverage", "manual_recoveries", "some"),
        ("auto_recovery_attempted", "replay", "auto_replays", "some"),
        ("auto_replay_success_rate_clean", "replay", "auto_replay_rate", "one"),
        ("auto_replay_failures_zero", "replay", "auto_replay_failures", "none"),
    ],
    "primary_step_lifecycle": [
        ("primary_step_started", "primary_lifecycle", "primary_started", "some"),
        ("primary_step_completed", "primary_lifecycle", "primary_completed", "some"),
        ("primary_step_failed", "primary_lifecycle", "primary_failed", "some"),
    ],
    "manual_recovery_actions": [
        ("manual_actions_recorded", "manual_recovery", "manual_actions", "some"),
        ("resume_after_partial_step_recorded", "manual_recovery", "resume_actions", "some"),
        ("retry_after_failed_step_recorded", "manual_recovery", "retry_actions", "some"),
        ("cancel_action_recorded", "manual_recovery", "cancel_actions", "some"),
        ("manual_action_failures_zero", "manual_recovery", "manual_action_failures", "none"),
    ],
    "step_replay_actions": [
        ("retry_step_recorded", "replay", "step_retries", "some"),
        ("resume_step_recorded", "replay", "step_resumes", "some"),
        ("step_replay_failures_zero", "replay", "step_replay_failures", "none"),
    ],
    "agent_task_recovery": [
        ("agent_task_recovery_recorded", "task_recovery", "task_recoveries", "some"),
        ("agent_task_resume_failures_zero", "task_recovery", "task_resume_failures", "none"),
    ],
    "planner_fallback_signal": [("planner_fallbacks_zero", "planner", "planner_fallbacks", "none")],
}
CATEGORIES = ["coverage", "manual_recovery", "primary_lifecycle", "replay", "task_recovery", "planner"]
STEP_EVENTS = {"primary_started": "step_started", "primary_completed": "step_completed", "primary_failed": "step_failed"}
ARTIFACT_TYPES = {"document.organize": "document_collection", "report.export": "report", "summary.create": "summary"}
GOAL_CHECKS = ["terminal_status_completed", "plan_steps_completed", "evidence_gaps_resolved", "deliverables_created", "no_pending_user_action", "research_phases_completed", "workflow_lifecycle_recorded"]


def _natural(value: Column, otherwise: Column | None = None) -> Column:
    """A number of at least 0 rounded down; else 0, or what is given."""
    number = value.cast("double")
    return F.when((number >= 0) & (number < 9e15), F.floor(number)).otherwise(F.lit(0) if otherwise is None else otherwise)


def recovery_stats(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, and a counter for everything that CASES asks for, with auto_replay_rate (four decimals, 0
    without attempts), step_events, task_scheduled, task_completed and task_resumes.

    events: by, trace_type, event_type, action, status, result_status, error, step_id, phase, and the
    numbers recoverable, manual, attempts, successes, failures, scheduled, refs; any may be null. One
    aggregation with partial sums, so a group that holds most events is no burden.
    """
    word = lambda c: F.trim(F.coalesce(c, F.lit("")))
    trace, event, action = word("trace_type"), word("event_type"), F.coalesce("action", F.lit(""))
    failed = (F.coalesce("status", F.lit("")) == "failed") | (F.coalesce("error", F.lit("")) != "")
    run, replay, task = trace == "agent_run_recovery", trace == "agent_run_step_replay", trace == "agent_task_recovery"
    step = trace.isin("agent_run_step_lifecycle", "") & event.isin(*STEP_EVENTS.values())
    primary = step & (F.coalesce("step_id", F.lit("")).endswith(":primary") | (F.lower(word("phase")) == "primary"))
    manual, startup = run & (event == "manual_recovery_action"), run & (event == "startup_recovery_completed")
    scheduled = _natural(F.col("scheduled"), _natural(F.col("refs")))
    resumed = task & (event == "task_resume_action")
    done = task & (event == "task_recovery_run") & ((F.coalesce("result_status", F.lit("")) == "completed") | (F.coalesce("status", F.lit("")) == "completed"))
    total = lambda when, number: F.coalesce(F.sum(F.when(when, number)), F.lit(0)).cast("long")
    sums = events.groupBy(*by).agg(
        *[total(startup, _natural(F.col(c))).alias(name) for name, c in (("recoverable_runs", "recoverable"), ("manual_recoveries", "manual"), ("auto_replays", "attempts"), ("auto_replay_successes", "successes"), ("auto_replay_failures", "failures"))],
        F.count_if(step).alias("step_events"),
        *[F.count_if(primary & (event == kind)).alias(name) for name, kind in STEP_EVENTS.items()],
        F.count_if(manual).alias("manual_actions"),
        *[F.count_if(manual & (action == kind)).alias(name) for name, kind in (("resume_actions", "resume_from_step"), ("retry_actions", "retry_failed_step"), ("cancel_actions", "cancel"))],
        F.count_if(manual & failed).alias("manual_action_failures"),
        F.count_if(replay & (action == "retry_step")).alias("step_retries"), F.count_if(replay & (action == "resume_step")).alias("step_resumes"), F.count_if(replay & failed).alias("step_replay_failures"),
        total(task & (event == "task_recovery_scheduled"), scheduled).alias("task_scheduled"), F.count_if(done).alias("task_completed"),
        F.count_if(resumed).alias("task_resumes"), F.count_if(resumed & failed).alias("task_resume_failures"),
        F.count_if((trace == "agent") & (event == "planner") & (F.coalesce("status", F.lit("")) == "fallback")).alias("planner_fallbacks"),
    )
    rate = F.when(F.col("auto_replays") > 0, fixed(F.col("auto_replay_successes") / F.col("auto_replays"))).otherwise(0.0)
    return sums.withColumns({"auto_replay_rate": rate, "task_recoveries": F.least("task_scheduled", "task_completed")})


def recovery_checks(stats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, case, check_no, check, category, passed: every check of every case for each group of stats."""
    met = {"some": lambda c: c >= 1, "none": lambda c: c == 0, "one": lambda c: c == 1}
    rows = [
        F.struct(F.lit(case).alias("case"), F.lit(n).alias("check_no"), F.lit(check).alias("check"), F.lit(category).alias("category"), met[kind](F.col(counter)).alias("passed"))
        for case, checks in CASES.items() for n, (check, category, counter, kind) in enumerate(checks)
    ]
    return stats.select(*by, F.explode(F.array(*rows)).alias("c")).select(*by, "c.*")


def recovery_summary(checks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by, cases, passed_cases, checks, passed_checks, the share of passed checks by category, status."""
    cases = checks.groupBy(*by, "case").agg(F.bool_and("passed").alias("whole"), F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("good"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORIES], *[F.count_if((F.col("category") == c) & F.col("passed")).alias(f"good_{c}") for c in CATEGORIES])
    rates = [fixed(F.sum(f"good_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"{c}_rate") for c in CATEGORIES]
    sums = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.count_if("whole").alias("passed_cases"), F.sum("n").alias("checks"), F.sum("good").alias("passed_checks"), *rates)
    return sums.withColumn("status", F.when(F.col("passed_checks") < F.col("checks"), "fail").otherwise("pass"))


def goal_checks(tasks: DataFrame, steps: DataFrame, deliverables: DataFrame, phases: DataFrame, id_col: str = "task_id") -> DataFrame:
    """id_col, check_no, check, passed: what a task must meet before its goal counts as reached.

    tasks: id_col, status, stopped_reason, required_action, pending (boolean), unresolved_gaps,
    unsupported_claims, deliverable_status, research_status (null: no research asked for), workflow_id,
    workflow_version, workflow_phase, workflow_status, workflow_checks, workflow_capabilities (arrays).
    steps: id_col, status. deliverables: id_col, part (planned or result), capability, status,
    artifact_id, artifact_type, artifact_status. phases: id_col, status. A task without steps has no
    finished plan. Parts of one task are counted before they meet it; blank texts are none.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    step_sums = steps.groupBy(id_col).agg(F.count(F.lit(1)).alias("steps"), F.count_if(said("status") == "completed").alias("steps_done"))
    phase_sums = phases.groupBy(id_col).agg(F.count(F.lit(1)).alias("phases"), F.count_if(said("status") == "completed").alias("phases_done"))
    wanted = F.create_map(*[F.lit(x) for pair in ARTIFACT_TYPES.items() for x in pair])
    kind = F.try_element_at(wanted, F.trim(F.col("capability")))
    made = (said("status") == "completed") & (said("artifact_id") != "") & (said("artifact_type") == kind) & said("artifact_status").isin("active", "archived")
    result = F.col("part") == "result"
    parts = deliverables.groupBy(id_col).agg(
        F.count_if(F.col("part") == "planned").alias("planned"), F.count_if(result).alias("results"),
        F.count_if(result & (said("status") == "completed")).alias("delivered"), F.count_if(result & (said("status") == "failed")).alias("undelivered"),
        # artifacts are looked for among results; among plans only while there is no result
        F.count_if(result & kind.isNotNull() & ~F.coalesce(made, F.lit(False))).alias("unmade"), F.count_if((F.col("part") == "planned") & kind.isNotNull()).alias("promised"),
    )
    rows = tasks.join(step_sums, id_col, "left").join(parts, id_col, "left").join(phase_sums, id_col, "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    lacking = F.when(count("results") > 0, count("unmade")).otherwise(count("promised"))
    finished = said("status") == "completed"
    no_research = F.col("research_status").isNull()
    all_named = lambda c: (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0) & F.forall(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    recorded = (said("workflow_id") != "") & (said("workflow_version") != "") & all_named("workflow_checks") & all_named("workflow_capabilities") & ((said("workflow_phase") != "") | (said("workflow_status") == "completed"))
    passed = [
        finished & said("stopped_reason").isin("", "completed"),
        (count("steps") > 0) & (count("steps_done") == count("steps")) & finished,
        (count("unresolved_gaps") == 0) & (count("unsupported_claims") == 0),
        (count("planned") == 0) | ((said("deliverable_status") == "completed") & (count("delivered") == count("planned")) & (count("undelivered") == 0) & (lacking == 0)),
        (said("required_action") == "") & ~F.coalesce("pending", F.lit(False)) & (said("deliverable_status") != "waiting_for_approval"),
        no_research | ((said("research_status") == "completed") & (count("phases") > 0) & (count("phases_done") == count("phases"))),
        no_research | recorded,
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("check_no"), F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, (name, ok) in enumerate(zip(GOAL_CHECKS, passed))])
    return rows.select(id_col, F.explode(listed).alias("c")).select(id_col, "c.*")


def goal_completion(checks: DataFrame, tasks: DataFrame, id_col: str = "task_id") -> DataFrame:
    """id_col, completion (completed, failed, running, pending, blocked), blockers (in order), summary."""
    blockers = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("check_no", "check")))), lambda b: b["check"])
    rows = tasks.select(id_col, "status").join(checks.groupBy(id_col).agg(blockers.alias("open")), id_col)
    count = F.size("open")
    status = F.when(count == 0, "completed").when(F.col("status") == "failed", "failed").when(F.col("status").isin("queued", "running"), "running").when(F.col("status") == "waiting_for_user", "pending").otherwise("blocked")
    blocked = F.concat(F.lit("Goal completion is blocked by "), count.cast("string"), F.when(count == 1, " check.").otherwise(" checks."))
    told = {"completed": "Goal completion checks passed.", "running": "Goal completion checks are still running.", "pending": "Goal completion checks are waiting for user action.", "failed": "Goal completion checks failed."}
    summary = blocked
    for name, text in told.items():
        summary = F.when(F.col("completion") == name, F.lit(text)).otherwise(summary)
    return rows.withColumn("completion", status).select(id_col, "completion", F.array_join("open", ",").alias("blockers"), summary.alias("summary"))
