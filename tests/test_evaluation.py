"""Evaluation, question and store operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import comparison, evaluation, gates, metrics, questions, state, telemetry, verify
from tessera.sources import store


def test_facts_are_matched_one_to_one(spark):
    """Against all assignments; units, currencies and repeats."""
    import itertools
    import random

    from tessera.operators import facts

    r = random.Random(1)
    for _ in range(200):
        fits = [[k for k in range(4) if r.random() < 0.4] for _ in range(r.randint(0, 4))]
        best = max(sum(k in fits[i] for i, k in enumerate(p[: len(fits)])) for p in itertools.permutations(range(4)))
        assert facts.matching(fits) == best
    pairs = [
        (1, "pay $1,000 within 30 days", "within 30 days you pay $1000"), (2, "30 days and 30 days", "30 days"), (3, "30 hours", "30 days"), (4, "5%", "5 percent"), (5, "10 USD", "$10"),
        (6, "30 and 30 days", "30 days, then 30"), (7, None, "1"), (8, "no number", None),
    ]
    frame = spark.createDataFrame(pairs, "id long, claim string, source string")
    loose = {x["id"]: (x["facts"], x["matched"]) for x in facts.fact_support(frame, ("id",)).collect()}
    assert loose == {1: (2, 2), 2: (2, 1), 3: (1, 0), 4: (1, 1), 5: (1, 1), 6: (2, 2), 7: (0, 0), 8: (0, 0)}


def rows(frame, *names):
    return sorted(map(tuple, frame.select(*names).collect()), key=str)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Twenty-five  days, 1,000 dollars", "25 days, 1000 dollars"), ("seventeen or eighty", "17 or 80"), ("thirty one", "31"), ("zero", "0"), ("someone tends", "someone tends"),
        ("one two", "1 2"), ("twenty ten", "20 10"), (None, None),
    ],
)
def test_match_form(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(evaluation.match_form(F.col("t"))).first()[0] == want


def test_contains_all(spark):
    frame = spark.createDataFrame([("It takes five days", ["5 days"]), ("It takes five days", ["6 days"]), ("x", []), ("x", None)], "a string, f array<string>")
    assert [r[0] for r in frame.select(evaluation.contains_all(F.col("a"), F.col("f"))).collect()] == [True, False, True, True]


def test_abstains(spark):
    frame = spark.createDataFrame([("So the comparison would be UNRELIABLE.",), ("fine",), (None,)], "a string")
    assert [r[0] for r in frame.select(evaluation.abstains(F.col("a"))).collect()] == [True, False, False]


def test_coverage(spark):
    cases = spark.createDataFrame([(i,) for i in range(1, 6)], "case_id int")
    schema = "case_id int, doc_key string, page_number int"
    cited = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "x", 1), (5, "b", 9)], schema)
    expected = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (2, "a", 2), (5, "b", None)], schema)
    assert rows(evaluation.coverage(cases, cited, expected), "case_id", "doc_hit", "page_hit") == [(1, True, True), (2, True, False), (3, False, False), (4, True, True), (5, True, True)]


@pytest.mark.parametrize(
    ("case", "want"),
    [
        (("no_difference", False, 1, 0, 0), (True, "ok")), (("no_difference", False, 1, 1, 2), (False, "supported_substantive_difference_present")),
        (("no_difference", True, 1, 0, 0), (False, "unexpected_abstention")), (("no_difference", False, 0, 0, 0), (False, "missing_supported_no_difference_verdict")),
        (("difference", False, 0, 2, 2), (True, "ok")), (("difference", False, 0, 1, 1), (False, "missing_supported_cross_document_difference")),
        (("difference", False, 1, 2, 2), (False, "supported_no_difference_verdict_present")), (("abstain", True, 0, 0, 0), (True, "ok")),
        (("abstain", False, 0, 0, 0), (False, "missing_required_abstention")), ((None, False, 0, 0, 0), (True, "not_applicable")),
    ],
)
def test_comparison_expectation(spark, case, want):
    frame = spark.createDataFrame([case], "e string, a boolean, n int, d int, docs int")
    assert tuple(frame.select(*[c.alias(str(i)) for i, c in enumerate(evaluation.comparison_expectation(*map(F.col, ("e", "a", "n", "d", "docs"))))]).first()) == want


def test_case_passed(spark):
    frame = spark.createDataFrame([(True, True, True, True), (True, False, True, True), (False, False, True, True), (False, False, False, True), (False, True, True, True)], "s boolean, a boolean, c boolean, d boolean")
    got = frame.select(evaluation.case_passed(F.col("s"), F.col("a"), F.lit(True), F.col("d"), F.col("d"), F.col("c"), F.lit(True))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False]


def test_divergence_and_fallbacks(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "case_id int, signature string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "y")], "case_id int, signature string")
    assert rows(evaluation.divergence(a, b), "case_id", "reason") == [(2, "planner_signature_mismatch"), (3, "missing_compare_case"), (4, "missing_provider_case")]
    cases = spark.createDataFrame([(True, True), (True, None), (False, None)], "fallback boolean, expected_fallback boolean")
    assert tuple(evaluation.fallback_rates(cases).first()) == (3, 2, 1, 0.3333)
    assert tuple(evaluation.fallback_rates(cases.limit(0)).first()) == (0, 0, 0, 0.0)


def test_remembered_claims_and_gaps(spark):
    checked = spark.createDataFrame([(1, "A  b", False), (1, "a b", True), (1, "c", False), (1, " ", True)], "answer_id int, claim string, supported boolean")
    assert rows(evaluation.remembered_claims(checked), "key", "supported") == [("a b", True), ("c", False)]
    verdicts = spark.createDataFrame([(1, "x,y"), (2, "")], "answer_id int, reasons string")
    assert rows(evaluation.evidence_gaps(verdicts), "answer_id", "gap_no", "gap") == [(1, 0, "x"), (1, 1, "y")]
    feedback = spark.createDataFrame([("Why  so?", "incomplete", [2, 1]), ("why so?", "incomplete", [2]), ("", "x", [1]), ("why so?", "citation_error", None)], "question string, kind string, doc_ids array<int>")
    assert rows(evaluation.feedback_cases(feedback), "question", "kind", "reports", "documents") == [("why so?", "citation_error", 1, ""), ("why so?", "incomplete", 2, "1,2")]


@pytest.mark.parametrize(
    ("query", "parts"),
    [
        ("What is the travel policy and when does it end?", ["What is the travel policy", "when does the travel policy end"]),
        ("Who approves the leave policy; what forms exist", ["Who approves the leave policy", "what forms exist for the approves the leave policy"]),
        ("Just one question", []),
        ("alpha beta and alpha beta", ["alpha beta"]),
    ],
)
def test_decompose(spark, query, parts):
    out = questions.decompose(spark.createDataFrame([(1, query), (2, None)], "query_id int, query string")).orderBy("part_no").collect()
    assert out[0]["is_primary"] and [r["part"] for r in out[1:]] == parts


@pytest.mark.parametrize(("query", "n", "want"), [("When is the deadline?", 1, ("timeline", 9, 4)), ("Compare them", 2, ("comparison", 8, 4)), ("Compare them", 1, ("fact", 4, 2)), ("List the risks", 1, ("analysis", 10, 4)), (None, 2, ("fact", 4, 2))])
def test_plans(spark, query, n, want):
    out = questions.plan(spark.createDataFrame([(1, query, n)], "query_id int, query string, documents int")).first()
    assert tuple(out)[1:] == want


def test_external_queries(spark):
    asked = spark.createDataFrame([(1, "Find the Acme budget for emp-123 travel travel x9"), (2, None)], "query_id int, query string")
    secrets = spark.createDataFrame([(1, "ACME")], "query_id int, term string")
    out = {r["query_id"]: r for r in questions.external_queries(asked, secrets, ["the", "for"]).collect()}
    assert out[1]["safe_query"] == "find budget travel" and out[1]["removed"] == 5
    assert out[1]["reasons"] == "generic_or_restricted_term,internal_identifier,sensitive_profile_term,unsafe_query_term"
    assert out[2]["safe_query"] == "" and out[2]["removed"] == 0


def test_gaps(spark):
    asked = spark.createDataFrame([(1, 'How many days does "annual leave" take?'), (2, "travel budget ceiling")], "query_id int, query string")
    found = spark.createDataFrame([(1, "annual leave is described here"), (2, "the budget of the garden")], "query_id int, chunk_text string")
    out = {(r["query_id"], r["requirement"]): r["status"] for r in questions.gaps(asked, found).collect()}
    assert out == {(1, "topic"): "partial", (1, "anchor:annual leave"): "covered", (1, "number"): "missing", (2, "topic"): "partial"}


def test_pair_score(spark):
    frame = spark.createDataFrame([("travel budget", "the travel budget"), ("travel budget", "budget"), ("the", "x"), ("travel budget", "")], "q string, t string")
    got = [round(r[0], 4) for r in frame.select(questions.lexical_pair_score(F.col("q"), F.col("t"))).collect()]
    assert got == [0.8, 0.275, 0.0, 0.0]


def test_topic_phrases(spark):
    frame = spark.createDataFrame([(1, ["budget"], "budget travel")], "doc_id int, tags array<string>, summary string")
    out = {r["phrase"]: r["weight"] for r in questions.topic_phrases(frame).collect()}
    assert out == {"budget": 9.8, "budget travel": 4.3, "travel": 1.3}


def test_attach_evidence(spark):
    cited = spark.createDataFrame([(1, 1, "d", 0), (1, 2, "d", 1), (1, None, "d", 5), (1, 9, "d", 0)], "answer_id int, rank int, doc_id string, chunk_index int")
    found = spark.createDataFrame([(1, 1, 1, "d", 0, "first"), (1, 1, 0, "other", 0, "vetoed"), (1, 2, 3, None, None, "second"), (1, None, 4, "d", 5, "by chunk")], "answer_id int, rank int, position int, doc_id string, chunk_index int, text string")
    out = rows(state.attach_evidence(cited, found), "rank", "chunk_index", "evidence")
    assert out == sorted([(1, 0, "first"), (2, 1, "second"), (None, 5, "by chunk"), (9, 0, None)], key=str)


def test_duplicates_by_priority(spark):
    schema = "doc_id int, a string, b string"
    known = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, None, "r")], schema)
    new = spark.createDataFrame([(10, "y", "p"), (11, "n", "p"), (12, None, "n"), (13, None, None)], schema)
    assert rows(state.match_duplicates(new, known, ("a", "b")), "doc_id", "match_id", "matched_by") == [(10, 2, "a"), (11, 1, "b"), (12, None, None), (13, None, None)]


def test_runs(spark):
    steps = spark.createDataFrame([(1, 1, "write", "running"), (1, 2, "retrieve", "paused"), (2, 1, "approval_gate", "pending"), (2, 2, "retrieve", "paused"), (3, 1, "write", "paused"), (4, 1, "retrieve", "completed")], "run_id int, seq int, type string, status string")
    want = [(1, "safe_step_ready", 2), (2, "pending_approval_gate", None), (3, "unsafe_step_type", None), (4, "no_safe_recoverable_step", None)]
    assert rows(state.recoverable_steps(steps, ["retrieve"]), "run_id", "reason", "step") == want
    assert rows(state.within_budget(steps, 1), "run_id", "seq") == [(1, 1), (2, 1), (3, 1), (4, 1)]
    before = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, w string")
    after = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "n", None)], "k int, v string, w string")
    assert rows(state.changed_rows(before, after, ("k",), ("v", "w")), "k") == [(2,)]


def test_ingest_is_all_or_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "doc_id int, chunk_index int, chunk_text string"
    assert store.current(spark, path) is None
    assert store.ingest(spark, spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], schema), path) == 0
    with pytest.raises(store.EmptyIngest):
        store.ingest(spark, spark.createDataFrame([], schema), path)
    assert store.current(spark, path).count() == 3
    assert store.ingest(spark, spark.createDataFrame([(1, 0, "A")], schema), path) == 1
    assert rows(store.current(spark, path), "doc_id", "chunk_text") == [(1, "A"), (2, "c")]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("at least 5 days", ["gte:5"]), ("no fewer than 1,000", ["gte:1000"]), ("no more than 5.0", ["lte:5"]), ("more than 3", ["gt:3"]), ("fewer than 7", ["lt:7"]),
        ("between 2 and 4 weeks", ["range:2:4"]), ("3 to 5 days", ["range:3:5"]), ("outside 3-5", ["outside:3:5"]), ("10 or more", ["gte:10"]), ("10 days or less", ["lte:10"]),
        ("about 50%", ["approx:50"]), ("exactly $20", ["eq:20"]), (">= 5 and < 9", ["gte:5", "lt:9"]), ("within 30 days", ["within:30"]), ("± 2", ["plusminus:2"]), ("不超过 8 天", ["lte:8"]),
        ("on 2024-01-05", []), ("plain 5 days", []), ("", []),
    ],
)
def test_constraints(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(verify.constraints(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("claim", "want"), [("Trips take at least 5 days", True), ("Trips take at most 5 days", False), ("Trips take more than 5 days", False)])
def test_constraints_decide_support(spark, claim, want):
    found = verify.claims(spark.createDataFrame([(1, claim)], "answer_id int, text string"))
    sources = spark.createDataFrame([(1, 1, 7, "Trips take at least 5 days.")], "answer_id int, rank int, doc_id int, text string")
    assert verify.check_claims(found, sources).first()["supported"] is want


def test_entailment_and_answers(spark):
    a, b = "Trips need approval. Meals cost 50 dollars.", "Meals cost 50 dollars. Trips need approval. Hotels are booked early."
    evidence = spark.createDataFrame([(1, 1, a), (1, 2, b), (2, 1, a), (2, 3, None)], "group_id int, doc_id int, text string")
    assert [tuple(r) for r in comparison.entailment(evidence).collect()] == [(1, 1, 2, True, False)]
    base = "Staff book travel early. The limit is 50 dollars. Managers approve trips. Receipts are kept for years."
    texts = spark.createDataFrame([(1, 1, base), (1, 2, base.replace("50", "75")), (2, 1, base), (2, 2, base)], "group_id int, doc_id int, text string")
    pairs = comparison.analyse_pairs(comparison.evidence_features(texts))
    lines = {r["group_id"]: r["line"] for r in comparison.diagnostics(pairs).collect()}
    assert lines[1].startswith("explicit conflict; term Jaccard") and lines[1].endswith("only left: 50; only right: 75") and lines[2].startswith("same evidence")
    chosen = texts.select("group_id", "doc_id", F.lit(1).alias("results"))
    said = {r["group_id"]: r["text"] for r in comparison.comparison_answers(comparison.verdicts(pairs, chosen), pairs).collect()}
    assert said == {1: "Documents 1 and 2 conflict (50 against 75).", 2: "The documents show no material difference."}


def test_threshold_gate_and_counters(spark):
    row = spark.createDataFrame([(0.5, None, 3.0)], "a double, b double, c double")
    assert rows(gates.threshold_gate(row, [("a", "min", 0.6, "fail"), ("b", "max", 1, "fail"), ("c", "max", 2, "warn"), ("c", "min", 2, "fail")]), "metric", "status") == [("a", "fail"), ("b", "unknown"), ("c", "pass"), ("c", "warn")]
    events = spark.createDataFrame([(1, "recovery_started"), (1, "recovery_completed"), (2, "recovery_started"), (2, "step_replayed")], "run_id int, type string")
    out = telemetry.recovery_counters(events).first()
    assert (out["runs"], out["recoveries"], out["recovered"], out["replays"], out["recovery_rate"]) == (2, 2, 1, 1, 0.5)
    assert metrics.sweep_variants(spark, k=[1, 2], w=[0.5]).count() == 2


def test_reference_contexts(spark):
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "doc_key string, page_number int, text string")
    expected = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, "c", 1)], "case_id int, doc_key string, page_number int")
    assert rows(evaluation.reference_contexts(expected, pages), "case_id", "text") == [(1, "y"), (2, "x"), (2, "y")]


def test_times_and_revisions(spark):
    from datetime import datetime

    day = lambda d, h=0: datetime(2024, 1, d, h)
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    parts = spark.createDataFrame([("u", day(8)), ("u", day(9, 12)), ("v", day(8))], "upload_id string, modified timestamp")
    assert rows(state.expired_uploads(parts, now), "upload_id") == [("v",)]
    audit = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, day(9)), (3, None)], "id int, created_at timestamp")
    assert rows(state.retained(audit, now), "id") == [(2,), (3,)]
    stored = spark.createDataFrame([("a", 3)], "run_id string, revision int")
    changes = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 3, 2), ("b", 4, 0)], "run_id string, change_id int, expected_revision int")
    assert rows(state.compare_and_set(stored, changes), "change_id", "applied", "revision") == [(1, True, 4), (2, False, 3), (3, False, 3), (4, True, 1)]
    tasks = spark.createDataFrame([(1, "queued", None, None), (2, "queued", day(11), None), (3, "running", None, day(9)), (4, "running", None, day(10, 1)), (5, "completed", None, None)], "task_id int, status string, due_at timestamp, lease_until timestamp")
    want = [(1, "claimable", 0), (2, "waiting", 86_400_000), (3, "claimable", 0), (4, "leased", 3_600_000), (5, "done", None)]
    assert rows(state.claim_states(tasks, now), "task_id", "state", "wait_ms") == want


def test_memories(spark):
    messages = spark.createDataFrame([("u", 1, "Please answer in English and keep it short."), ("u", 2, "Remember that the budget code is Q4"), ("u", 3, "remember to reply in Chinese"), ("u", 4, None), ("u", 5, "记住：周五提交报告")], "owner string, message_id int, text string")
    out = rows(state.memory_candidates(messages), "message_id", "category", "key", "value")
    assert out == sorted([(1, "preference", "reply_language", "en"), (1, "preference", "answer_style", "concise"), (2, "note", None, "the budget code is Q4"), (3, "preference", "reply_language", "zh"), (5, "note", None, "周五提交报告")], key=str)
    schema = "owner string, category string, key string, text string"
    stored = spark.createDataFrame([(1, "u", "p", "lang", "en", False), (2, "u", "n", None, "note", False), (3, "u", "n", None, "old", True)], f"note_id int, {schema}, archived boolean")
    arrivals = spark.createDataFrame([(10, "u", "p", "lang", "zh"), (11, "u", "n", None, "note"), (12, "u", "n", None, "old"), (13, "v", "n", None, "note")], f"arrival_id int, {schema}")
    assert rows(state.upsert_memories(stored, arrivals), "arrival_id", "note_id", "is_new") == [(10, 1, False), (11, 2, False), (12, None, True), (13, None, True)]


def test_compare_batches(spark):
    batches = spark.createDataFrame([(1, 1, [1, 1]), (1, 2, [1, 2]), (2, 1, [3])], "query_id int, batch_no int, doc_ids array<int>")
    selected = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4])], "query_id int, doc_ids array<int>")
    assert rows(state.compare_batches(batches, selected), "query_id", "batch_no", "doc_ids") == [(1, 1, [1, 2]), (2, 1, [3, 4])]


def test_many_equal_facts_and_words_that_are_no_units(spark):
    from tessera.operators import facts

    rows = [(1, "3 days " * 1500, "3 days " * 1500), (2, "$5 to staff", "$5 in cash")]
    got = facts.fact_support(spark.createDataFrame(rows, "id long, claim string, source string"), ("id",), strict=True)
    assert {r["id"]: (r["facts"], r["matched"], r["supported"]) for r in got.collect()} == {1: (1500, 1500, True), 2: (1, 1, True)}


def test_baselines_against_brute_force(spark):
    import random

    from tessera.operators import gates

    rng = random.Random(5)
    draw = lambda: (rng.randint(1, 6), rng.choice(["p", "q", None]), rng.choice(["c", "d", None]))
    runs = [(k, *draw(), rng.random() < 0.6) for k in range(80)]
    wanted = [(100 + k, *draw()) for k in range(60)]
    schema = "run_id long, created int, profile string, corpus string"
    found = gates.latest_baseline(spark.createDataFrame(runs, schema + ", passed boolean"), spark.createDataFrame(wanted, schema)).collect()

    def expected(created, profile, corpus):
        for name, fits in (("profile_and_corpus", lambda r: (r[2], r[3]) == (profile, corpus)), ("corpus", lambda r: r[3] == corpus), ("profile", lambda r: r[2] == profile)):
            earlier = [(r[1], r[0]) for r in runs if r[4] and r[1] < created and fits(r)]
            if earlier:
                return max(earlier)[1], name
        return None, "none"

    assert {r["run_id"]: (r["baseline_id"], r["strategy"]) for r in found} == {w[0]: expected(*w[1:]) for w in wanted}
    assert gates.latest_baseline(spark.createDataFrame([], schema + ", passed boolean"), spark.createDataFrame(wanted[:3], schema)).where("strategy <> 'none'").count() == 0
