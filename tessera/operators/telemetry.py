"""Roll-ups of traces, model calls and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import fixed, ratio


def llmops_rollup(calls: DataFrame) -> DataFrame:
    """Model calls at three grains in one pass: all, by operation, by route.

    calls: operation, route, status (ok, error, skipped, ...), latency_ms, tokens, cost, slo.
    """
    grouped = calls.groupingSets([[], [F.col("operation")], [F.col("route")]], "operation", "route").agg(
        F.grouping_id().alias("grain"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("slo") == "breach").alias("breaches"),
        fixed(F.avg("latency_ms"), 3).alias("mean_latency"),
        F.sum("tokens").alias("tokens"),
        fixed(F.sum("cost"), 4).alias("cost"),
    )
    grain = F.when(F.col("grain") == 3, "all").when(F.col("grain") == 1, "operation").otherwise("route")
    return grouped.select(grain.alias("grain"), F.coalesce("operation", "route", F.lit("")).alias("name"), "calls", "ok", "errors", "skipped", "breaches", ratio(F.col("errors"), F.col("calls")).alias("error_rate"), "mean_latency", "tokens", "cost")


def rag_rollup(traces: DataFrame) -> DataFrame:
    """Per route mode: traces, mean latency and citations, abstain rate. traces: mode, latency_ms, citations, abstained."""
    return traces.groupBy("mode").agg(
        F.count(F.lit(1)).alias("traces"),
        fixed(F.avg("latency_ms"), 3).alias("mean_latency"),
        fixed(F.avg("citations"), 4).alias("mean_citations"),
        ratio(F.count_if("abstained"), F.count(F.lit(1))).alias("abstain_rate"),
    )


def status_counts(rows: DataFrame, domain: DataFrame, status_col: str = "status") -> DataFrame:
    """status, n for every status of the domain, 0 where there is none. domain: status."""
    found = rows.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return domain.select("status").distinct().join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def planner_rollup(plans: DataFrame, reasons: int = 5) -> DataFrame:
    """planner, reason_rank, reason, n, fallback_rate: the commonest fallback reasons of each planner.

    plans: planner, fallback (boolean), reason.
    """
    rates = plans.groupBy("planner").agg(ratio(F.count_if("fallback"), F.count(F.lit(1))).alias("fallback_rate"))
    counted = plans.where("fallback AND reason IS NOT NULL").groupBy("planner", "reason").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("planner").orderBy(F.desc("n"), "reason")
    ranked = counted.withColumn("reason_rank", F.row_number().over(order)).where(F.col("reason_rank") <= reasons)
    return ranked.join(rates, "planner").select("planner", "reason_rank", "reason", "n", "fallback_rate")


def skill_rollup(runs: DataFrame) -> DataFrame:
    """skill, attempts, successes, failures, success_rate. runs: skill, status."""
    grouped = runs.groupBy("skill").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "ok").alias("successes"), F.count_if(F.col("status") == "error").alias("failures"))
    return grouped.withColumn("success_rate", fixed(F.col("successes") / F.greatest(F.col("attempts"), F.lit(1))))


def conditional_rates(cases: DataFrame, rates: dict[str, tuple[str, str]], by: tuple[str, ...] = ()) -> DataFrame:
    """For each name the share of rows meeting the first SQL condition among those meeting the second; null if none do."""
    shares = [ratio(F.count_if(F.expr(f"({of}) AND ({hit})")), F.count_if(F.expr(of))).alias(name) for name, (hit, of) in rates.items()]
    return cases.groupBy(*by).agg(*shares)


def feedback_failures(feedback: DataFrame, limit: int = 12) -> DataFrame:
    """skill, failures, kinds, examples: the first `limit` ids of each skill's failures, by id.

    feedback: skill, feedback_id, kind. Ids beyond the limit are dropped before they are gathered.
    """
    order = Window.partitionBy("skill").orderBy("feedback_id")
    first = feedback.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit)
    examples = first.groupBy("skill").agg(F.array_join(F.transform(F.array_sort(F.collect_list("feedback_id")), lambda i: i.cast("string")), ",").alias("examples"))
    counted = feedback.groupBy("skill").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("kind").alias("kinds"))
    return counted.join(examples, "skill")


# Event types of a run's life, by the counter they feed.
RECOVERY_EVENTS = {"recoveries": ["recovery_started"], "recovered": ["recovery_completed"], "failed_recoveries": ["recovery_failed"], "manual": ["manual_recovery"], "replays": ["step_replayed", "run_replayed"]}


def recovery_counters(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, runs, a counter for each of RECOVERY_EVENTS, recovery_rate. events: run_id, type."""
    counters = [F.count_if(F.col("type").isin(kinds)).alias(name) for name, kinds in RECOVERY_EVENTS.items()]
    sums = events.groupBy(*by).agg(F.count_distinct("run_id").alias("runs"), *counters)
    return sums.withColumn("recovery_rate", ratio(F.col("recovered"), F.col("recoveries")))
