"""Gap plans, recovery evaluation and goal completion on small cases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gap_plan, recovery
from tessera.operators.retrieval import merge_queries

RESULT = "query_id long, place int, doc_id long, chunk_index int, score double, keyword double, file_name string, section_heading string, chunk_text string"


def results(spark, *rows):
    return spark.createDataFrame([r if len(r) == 9 else (*r[:4], 0.5, 0.3, *r[4:]) for r in rows], RESULT)


def questions(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query string")


def needs_of(spark, text):
    return [(r["kind"], r["label"]) for r in gap_plan.needs(questions(spark, text)).orderBy("need").collect()]


def status_of(spark, text, *rows):
    asked = gap_plan.needs(questions(spark, text))
    found = results(spark, *[(0, i + 1, i, 0, *r) for i, r in enumerate(rows)])
    return {(r["kind"], r["label"]): r["status"] for r in gap_plan.judged(gap_plan.graded(asked, found)).collect()}


def test_needs_follow_the_wording(spark):
    assert needs_of(spark, "When does the travel reimbursement policy take effect?") == [("topic", "travel reimbursement"), ("time", "effective date or timing")]
    assert needs_of(spark, "Is remote work allowed?") == [("topic", "remote work allowed"), ("explicit_answer", "clear answer")]
    assert needs_of(spark, "How much is the parking fee and which users are eligible?") == [
        ("topic", "parking users"), ("number", "amount, percentage, or duration"), ("scope", "scope, audience, or region"),
    ]
    assert needs_of(spark, "差旅报销何时生效") == [("topic", "差旅报销何时生效"), ("time", "生效日期或时间条件")]


def test_anchors_are_needs_and_the_first_is_the_topic(spark):
    assert needs_of(spark, 'Where is ISO-27001 or iso-27001 and "Data Owner" named?') == [("topic", "ISO-27001"), ("anchor", "ISO-27001"), ("anchor", "Data Owner")]
    # quoted words without meaning are no anchors
    assert needs_of(spark, 'Where is "of the" named?')[0][0] == "topic"


def test_null_and_empty_questions_need_nothing(spark):
    assert gap_plan.needs(questions(spark, None, "", "?!")).count() == 0


def test_given_missing_anchors_replace_those_of_the_query(spark):
    rows = questions(spark, "AB-1 and CD-2").withColumn("missing_anchors", F.slice(gap_plan.named_anchors(F.col("query")), 2, 1))
    assert [r["label"] for r in gap_plan.needs(rows).where("kind = 'anchor'").collect()] == ["CD-2"]


def test_grades(spark):
    asked = "When does parking start?"
    time = ("time", "effective date or timing")
    assert status_of(spark, asked, ("f", None, "Parking opens on 2024-05-01."))[time] == "covered"
    assert status_of(spark, asked, ("f", None, "Parking: valid from spring"))[time] == "covered"
    assert status_of(spark, asked, ("f", "Effective period", "Effective period\nopens in spring"))[time] == "partial"
    assert status_of(spark, asked, ("f", None, "Parking opens in spring"))[time] == "missing"
    # the heading is no evidence in the body, wherever it is repeated at its beginning
    assert status_of(spark, "Is parking allowed?", ("f", "Allowed rule", "allowed RULE text"))[("explicit_answer", "clear answer")] == "partial"
    assert status_of(spark, "Is parking allowed?", ("f", None, "Parking is permitted"))[("explicit_answer", "clear answer")] == "covered"
    assert status_of(spark, "How much is parking?", ("f", None, "The amount varies"))[("number", "amount, percentage, or duration")] == "partial"
    assert status_of(spark, "How much is parking?", ("f", None, "It is three coins"))[("number", "amount, percentage, or duration")] == "covered"


@pytest.mark.parametrize(("text", "status"), [("alpha beta gamma", "covered"), ("alpha beta", "partial"), ("zeta", "missing")])
def test_topic_shares(spark, text, status):
    assert status_of(spark, "alpha gamma delta epsilon", ("f", None, "alpha gamma delta" if status == "covered" else text))[("topic", "alpha gamma delta epsilon")] == status


def test_only_six_results_count_and_a_question_without_results_keeps_its_needs(spark):
    asked = gap_plan.needs(questions(spark, "alpha?"))
    late = results(spark, (0, 7, 1, 0, "f", None, "alpha"))
    for found in (late, late.where("false")):
        verdicts = gap_plan.judged(gap_plan.graded(asked, found))
        assert [r["status"] for r in verdicts.collect()] == ["missing"]
        plan = gap_plan.plans(verdicts, gap_plan.graded(asked, found)).collect()[0]
        assert not plan["related"] and plan["summary"] == "I have not found reliable evidence that directly answers alpha."
        assert gap_plan.locations(gap_plan.graded(asked, found), verdicts).count() == 0


def test_searches_are_three_at_most_and_unlike(spark):
    asked = gap_plan.needs(questions(spark, 'Is "red fox" allowed, when, and how much?'))
    verdicts = gap_plan.judged(gap_plan.graded(asked, results(spark, (0, 1, 1, 0, "f", None, "nothing"))))
    found = gap_plan.searches(verdicts).orderBy("search_no").collect()
    # topic and anchor give one search; the third of the first three needs is time
    assert [(r["search_no"], r["search"]) for r in found] == [(1, "red fox"), (3, "red fox effective date timing")]
    terms = {r["term"] for r in gap_plan.search_terms(asked).collect()}
    assert {"red", "fox", "effective", "prohibited", "percentage"} <= terms


def test_locations_rank_hints_and_fall_back_to_close_results(spark):
    asked = gap_plan.needs(questions(spark, "alpha gamma delta epsilon zeta: when?"))
    found = results(spark, (0, 1, 1, 0, 0.9, 0.1, "f", "Effective", "nothing"), (0, 2, 2, 0, 0.1, 0.5, "f", None, "alpha here"), (0, 3, 3, 0, 0.1, 0.9, "f", None, "none"))
    grades = gap_plan.graded(asked, found)
    rows = gap_plan.locations(grades, gap_plan.judged(grades)).orderBy("place").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(1, 4.0), (2, 3.6)]
    assert rows[0]["reason"] == "This may help fill: effective date or timing."
    far = gap_plan.graded(asked, results(spark, (0, 1, 1, 0, 0.9, 0.1, "f", None, "nothing"), (0, 2, 2, 0, 0.1, 0.5, "f", None, "none")))
    rows = gap_plan.locations(far, gap_plan.judged(far)).collect()
    assert [(r["doc_id"], r["reason"]) for r in rows] == [(2, "This is one of the closest related passages retrieved so far.")]


def test_labels_in_words_and_chinese_plans(spark):
    row = spark.range(1).select(*[gap_plan.joined_labels(F.array(*map(F.lit, xs)), F.lit(lang)).alias(f"c{i}") for i, (xs, lang) in enumerate([("ab", "en"), ("abc", "en"), ("aa", "en"), ("abc", "zh")])]).first()
    assert list(row) == ["a and b", "a, b, and c", "a", "a、b、c"]
    asked = gap_plan.needs(questions(spark, "“差旅”何时生效"))
    grades = gap_plan.graded(asked, results(spark, (0, 1, 1, 0, "f", None, "差旅说明")))
    plan = gap_plan.plans(gap_plan.judged(grades), grades).first()
    assert plan["summary"] == "我找到了一些和“差旅”相关的内容，但还不能可靠确认生效日期或时间条件。" and plan["follow_ups"].startswith("请只找这份文档里的生效日期")


def test_a_second_search_closes_a_gap(spark):
    asked = gap_plan.needs(questions(spark, "When does parking start?"))
    first = results(spark, (0, 1, 1, 0, "f", None, "parking lots"))
    before = gap_plan.judged(gap_plan.graded(asked, first))
    assert {r["kind"]: r["status"] for r in before.collect()} == {"topic": "partial", "time": "missing"}
    second = results(spark, (0, 1, 1, 0, "f", None, "parking lots"), (0, 2, 2, 0, "f", None, "valid from 2024-01-01"))
    rows = first.selectExpr("query_id AS question_id", "0 AS sub_query", "place AS position", "doc_id", "chunk_index", "score", "keyword").unionByName(
        second.selectExpr("query_id AS question_id", "1 AS sub_query", "place AS position", "doc_id", "chunk_index", "score", "keyword")
    )
    merged = merge_queries(rows).withColumnRenamed("question_id", "query_id").join(second.select("doc_id", "file_name", "section_heading", "chunk_text"), "doc_id")
    assert merged.count() == 2
    after = gap_plan.judged(gap_plan.graded(asked, merged))
    assert [r["status"] for r in after.where("kind = 'time'").collect()] == ["covered"]


EVENT = "g int, trace_type string, event_type string, action string, status string, result_status string, error string, step_id string, phase string, recoverable int, manual int, attempts int, successes int, failures int, scheduled int, refs int"
GOOD = [
    dict(trace_type="agent_run_recovery", event_type="startup_recovery_completed", recoverable=2, manual=1, attempts=1, successes=1, failures=0),
    dict(event_type="step_started", step_id="x:primary"), dict(event_type="step_completed", phase=" Primary"), dict(event_type="step_failed", step_id="x:primary"), dict(event_type="step_failed", step_id="x:2"),
    *[dict(trace_type="agent_run_recovery", event_type="manual_recovery_action", action=a, status="completed") for a in ("resume_from_step", "retry_failed_step", "cancel")],
    *[dict(trace_type="agent_run_step_replay", action=a, status="completed") for a in ("resume_step", "retry_step")],
    dict(trace_type="agent_task_recovery", event_type="task_recovery_scheduled", refs=1), dict(trace_type="agent_task_recovery", event_type="task_recovery_run", result_status="completed"),
    dict(trace_type="agent_task_recovery", event_type="task_resume_action", action="confirm", status="completed"), dict(trace_type="agent", event_type="planner", status="selected"),
]


def traces(spark, *rows):
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, 0 if n == "g" else None) for n in names) for r in rows], EVENT)


def evaluated(spark, *rows):
    stats = recovery.recovery_stats(traces(spark, *rows), ("g",))
    checks = recovery.recovery_checks(stats, ("g",))
    return stats.first(), {r["check"] for r in checks.where("NOT passed").collect()}, recovery.recovery_summary(checks, ("g",)).first()


def test_a_whole_recovery_passes_every_case(spark):
    stats, failed, summary = evaluated(spark, *GOOD)
    assert (stats["step_events"], stats["primary_started"], stats["primary_failed"], stats["task_scheduled"], stats["auto_replay_rate"]) == (4, 1, 1, 1, 1.0)
    assert not failed and (summary["cases"], summary["passed_cases"], summary["checks"], summary["status"]) == (6, 6, 19, "pass")


@pytest.mark.parametrize(("row", "check"), [
    (dict(trace_type="agent_run_recovery", event_type="startup_recovery_completed", recoverable=-3, attempts=1, successes=0, failures=1), "auto_replay_success_rate_clean"),
    (dict(trace_type="agent_run_recovery", event_type="manual_recovery_action", action="cancel", error="x"), "manual_action_failures_zero"),
    (dict(trace_type="agent_run_step_replay", status="failed"), "step_replay_failures_zero"),
    (dict(trace_type="agent_task_recovery", event_type="task_resume_action", status="failed"), "agent_task_resume_failures_zero"),
    (dict(trace_type="agent", event_type="planner", status="fallback"), "planner_fallbacks_zero"),
])
def test_one_failure_fails_its_check(spark, row, check):
    stats, failed, summary = evaluated(spark, *GOOD, row)
    assert check in failed and stats["recoverable_runs"] == 2 and summary["status"] == "fail"


def test_groups_apart_and_no_events(spark):
    stats = recovery.recovery_stats(traces(spark, *GOOD, dict(g=1, trace_type="other", event_type="step_started", step_id="x:primary")), ("g",))
    assert {r["g"]: r["primary_started"] for r in stats.collect()} == {0: 1, 1: 0}
    assert recovery.recovery_checks(recovery.recovery_stats(traces(spark, *GOOD).where("false"), ("g",)), ("g",)).count() == 0


TASK = "task_id int, status string, stopped_reason string, required_action string, pending boolean, unresolved_gaps long, unsupported_claims long, deliverable_status string, research_status string, workflow_id string, workflow_version string, workflow_phase string, workflow_status string, workflow_checks array<string>, workflow_capabilities array<string>"
WHOLE = dict(status="completed", stopped_reason="completed", pending=False, unresolved_gaps=0, unsupported_claims=0, deliverable_status="completed", research_status="completed", workflow_id="w", workflow_version="1", workflow_status="completed", workflow_checks=["a"], workflow_capabilities=["summary.create"])
PART = "task_id int, part string, capability string, status string, artifact_id string, artifact_type string, artifact_status string"
MADE = [(1, "planned", "summary.create", "completed", None, None, None), (1, "result", "summary.create", "completed", "a1", "summary", "active")]


def goal(spark, steps=("completed",), parts=(), phases=("completed",), **changes):
    names = [c.split()[0] for c in TASK.split(", ")]
    row = WHOLE | changes | {"task_id": 1}
    tasks = spark.createDataFrame([tuple(row.get(n) for n in names)], TASK)
    states = lambda xs: spark.createDataFrame([(1, x) for x in xs], "task_id int, status string")
    checks = recovery.goal_checks(tasks, states(steps), spark.createDataFrame(list(parts), PART), states(phases))
    row = recovery.goal_completion(checks, tasks).first()
    return row["completion"], row["blockers"]


@pytest.mark.parametrize(("given", "expected"), [
    ({}, ("completed", "")),
    ({"parts": MADE}, ("completed", "")),
    ({"parts": MADE[:1]}, ("blocked", "deliverables_created")),
    ({"parts": [MADE[0], (1, "result", "summary.create", "completed", " ", "summary", "active")]}, ("blocked", "deliverables_created")),
    ({"parts": [MADE[0], (1, "result", "summary.create", "completed", "a1", None, "active")]}, ("blocked", "deliverables_created")),
    ({"parts": [(1, "planned", "other", "completed", None, None, None), (1, "result", "other", "completed", None, None, None)]}, ("completed", "")),
    ({"steps": ()}, ("blocked", "plan_steps_completed")),
    ({"steps": ("completed", None)}, ("blocked", "plan_steps_completed")),
    ({"stopped_reason": "budget"}, ("blocked", "terminal_status_completed")),
    ({"unsupported_claims": 1}, ("blocked", "evidence_gaps_resolved")),
    ({"required_action": "approve"}, ("blocked", "no_pending_user_action")),
    ({"deliverable_status": "waiting_for_approval"}, ("blocked", "no_pending_user_action")),
    ({"phases": ()}, ("blocked", "research_phases_completed")),
    ({"research_status": None, "phases": (), "workflow_id": None}, ("completed", "")),
    ({"workflow_checks": ["a", None]}, ("blocked", "workflow_lifecycle_recorded")),
    ({"workflow_status": None}, ("blocked", "workflow_lifecycle_recorded")),
    ({"status": "failed"}, ("failed", "terminal_status_completed,plan_steps_completed")),
    ({"status": "queued"}, ("running", "terminal_status_completed,plan_steps_completed")),
    ({"status": "waiting_for_user"}, ("pending", "terminal_status_completed,plan_steps_completed")),
])
def test_goal_completion(spark, given, expected):
    assert goal(spark, **given) == expected
