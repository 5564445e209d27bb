"""Quality gates, service levels, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {"pass": 0, "unknown": 0, "warn": 1, "fail": 2}
# For each metric, the fall that warns and the fall that fails.
REGRESSION_LIMITS = {"ndcg": (0.01, 0.03), "recall": (0.01, 0.03), "mrr": (0.01, 0.03), "precision": (0.02, 0.05)}


def regression_check(delta: Column, warn: Column, fail: Column) -> Column:
    """pass, warn or fail by how far a metric fell; unknown where it can't be told."""
    return F.when(delta.isNull(), "unknown").when(delta <= -fail, "fail").when(delta <= -warn, "warn").otherwise("pass")


def regression_gate(baseline: DataFrame, current: DataFrame, limits: dict[str, tuple[float, float]] = REGRESSION_LIMITS) -> DataFrame:
    """metric, before, after, status; both inputs are one row with a column per metric."""
    table = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("double").alias("before"), F.col(f"a.{m}").cast("double").alias("after"), F.lit(w).alias("warn"), F.lit(f).alias("fail")) for m, (w, f) in limits.items()]))
    rows = baseline.alias("b").join(F.broadcast(current.alias("a"))).select(table.alias("x")).select("x.*")
    change = F.round((F.col("after") - F.col("before")) * 10000) / 10000
    return rows.select("metric", "before", "after", regression_check(change, F.col("warn"), F.col("fail")).alias("status"))


def worst_status(checks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, status: the worst of the checks' statuses."""
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = checks.groupBy(*by).agg(F.max(rank).alias("r"))
    return worst.select(*by, F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("status"))


def case_delta_status(new_failures: Column) -> Column:
    """One newly failed case warns, two fail."""
    return F.when(new_failures >= 2, "fail").when(new_failures == 1, "warn").otherwise("pass")


def run_status(pass_rate: Column, failures: Column) -> Column:
    return F.when((pass_rate >= 0.99) & (failures == 0), "ok").when(pass_rate >= 0.8, "warn").otherwise("fail")


def slo_status(latency: Column, limit: Column) -> Column:
    """pass or breach; unavailable where either is null or negative."""
    known = latency.isNotNull() & limit.isNotNull() & (latency >= 0) & (limit >= 0)
    return F.when(~F.coalesce(known, F.lit(False)), "unavailable").when(latency <= limit, "pass").otherwise("breach")


def budget_status(spent: Column, limit: Column) -> Column:
    return F.when(spent.isNull() | limit.isNull(), "unavailable").when(spent > limit, "exceeded").otherwise("ok")


def budget_alerts(tokens: Column, token_limit: Column, cost: Column, cost_limit: Column, latency: Column, latency_limit: Column) -> Column:
    """Which limits were passed, in a fixed order."""
    found = [("token_budget", tokens > token_limit), ("cost_budget", cost > cost_limit), ("latency_slo", latency > latency_limit)]
    return F.array_compact(F.array(*[F.when(F.coalesce(yes, F.lit(False)), F.lit(name)) for name, yes in found]))


def latest_baseline(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with baseline_id and strategy: the newest earlier run of the same profile and corpus,
    else of the same corpus, else of the same profile, else none; only passed runs count.

    runs: run_id, created, profile, corpus, passed. wanted: run_id, created, profile, corpus.
    Runs are folded to the largest run_id of each profile, corpus and time, wanted runs to their
    distinct ones, before three windows order them by corpus and profile, by corpus and by profile; so
    a corpus or profile that most runs share holds no more rows than it has profiles (or corpora) and
    times. Each wanted run then takes the answer of its profile, corpus and time.
    """
    keys = ["created", "profile", "corpus"]
    good = runs.where("passed").groupBy(*keys).agg(F.max("run_id").alias("baseline_id"))
    marks = wanted.select(*keys).distinct().withColumn("baseline_id", F.lit(None).cast(good.schema["baseline_id"].dataType))
    events = marks.withColumn("asked", F.lit(True)).unionByName(good.withColumn("asked", F.lit(False)))
    order = lambda *by: Window.partitionBy(*by).orderBy("created", ~F.col("asked"), "baseline_id").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda *by: F.last("baseline_id", ignorenulls=True).over(order(*by))
    found = events.withColumns({"same": last("profile", "corpus"), "by_corpus": last("corpus"), "by_profile": last("profile")}).where("asked")
    found = found.select(*[F.col(k).alias(f"a_{k}") for k in keys], "same", "by_corpus", "by_profile")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"a_{k}"))
    strategy = F.when(F.col("same").isNotNull(), "profile_and_corpus").when(F.col("by_corpus").isNotNull(), "corpus").when(F.col("by_profile").isNotNull(), "profile").otherwise("none")
    return wanted.join(found, met).select("run_id", F.coalesce("same", "by_corpus", "by_profile").alias("baseline_id"), strategy.alias("strategy"))


def threshold_gate(metrics: DataFrame, limits: list[tuple[str, str, float, str]]) -> DataFrame:
    """metric, value, status of one row of metrics against limits (metric, "min" or "max", bound,
    status if broken); unknown where the metric is null."""
    checks = []
    for metric, kind, bound, broken in limits:
        value = F.col(metric).cast("double")
        bad = value < bound if kind == "min" else value > bound
        checks.append(F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.when(value.isNull(), "unknown").when(bad, broken).otherwise("pass").alias("status")))
    return metrics.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
