"""Ranking quality, latency percentiles, and sweep scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import fixed, ratio


def relevant_first(ranking: DataFrame, expected: DataFrame, units: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ranking (query_id, units, rank) with grade: 2 where an expected unit occurs first, else 0."""
    marked = ranking.join(expected.select("query_id", *units, F.lit(1).alias("wanted")).distinct(), ["query_id", *units], "left")
    turn = F.row_number().over(Window.partitionBy("query_id", *units).orderBy("rank"))
    return marked.withColumn("grade", F.when(F.col("wanted").isNotNull() & (turn == 1), 2).otherwise(0)).drop("wanted")


def dcg(grade: Column, rank: Column) -> Column:
    """One result's part of the discounted gain."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def ranking_metrics(ranking: DataFrame, expected: DataFrame, k: int, units: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per query: ndcg, precision, recall, mrr, noise at k.

    The ideal has grade 2 for all expected units, cut at k. Precision is over the results returned,
    recall over the expected units. Null: ndcg and recall without expected units, precision and
    noise without results.
    """
    graded = relevant_first(ranking.where(F.col("rank") <= k), expected, units)
    found = graded.groupBy("query_id").agg(
        F.sum(dcg(F.col("grade"), F.col("rank"))).alias("gain"),
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("grade") > 0).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_hit"),
    )
    wanted = expected.select("query_id", *units).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("units"))
    rows = found.join(wanted, "query_id", "full_outer")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("units"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + dcg(F.lit(2), i))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "query_id",
        fixed(F.when(F.col("units") > 0, F.coalesce("gain", F.lit(0.0)) / ideal)).alias("ndcg"),
        ratio(zero("hits"), zero("returned")).alias("precision"),
        ratio(zero("hits"), zero("units")).alias("recall"),
        fixed(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"),
        ratio(zero("returned") - zero("hits"), zero("returned")).alias("noise"),
    )


def rank_lift(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, ndcg_lift, recall_lift, mrr_lift, noise_reduction: after less before, in 1/10000."""
    delta = lambda a, b: (F.round(F.col(a) * 10000) - F.round(F.col(b) * 10000)).cast("long")
    rename = lambda df, p: df.select("query_id", *[F.col(c).alias(f"{p}_{c}") for c in ("ndcg", "recall", "mrr", "noise")])
    both = rename(before, "b").join(rename(after, "a"), "query_id")
    return both.select("query_id", delta("a_ndcg", "b_ndcg").alias("ndcg_lift"), delta("a_recall", "b_recall").alias("recall_lift"), delta("a_mrr", "b_mrr").alias("mrr_lift"), delta("b_noise", "a_noise").alias("noise_reduction"))


def noise_filtering(before: DataFrame, after: DataFrame, expected: DataFrame, units: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """query_id, noise_before, filtered, rate: distinct unexpected units of the first ranking that the second drops."""
    noise = before.select("query_id", *units).distinct().join(expected, ["query_id", *units], "left_anti")
    kept = after.select("query_id", *units, F.lit(1).alias("kept")).distinct()
    rows = noise.join(kept, ["query_id", *units], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("noise_before"), F.count_if(F.col("kept").isNull()).alias("filtered"))
    return rows.withColumn("rate", ratio(F.col("filtered"), F.col("noise_before")))


#: Bands into which the values of a group are dealt to find a percentile.
BANDS = 4096


def percentiles(values: DataFrame, by: tuple[str, ...], value_col: str = "value", digits: int = 3) -> DataFrame:
    """by, n, least, most, mean, p50, p90, p95, p99: nearest-rank percentiles, exact at any size.

    Equal values are folded, and a group's values dealt into bands between its least and greatest.
    Counts by band tell in which band each rank lies, and only the values of those bands are ordered,
    so no task or buffer holds all values of a group. Null values don't count.
    """
    keys, value = ["k"], F.col(value_col)
    known = values.where(value.isNotNull()).select(F.struct(*by).alias("k"), value.alias("v"))  # null keys are equal within a struct
    sums = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    folded = known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BANDS), F.lit(BANDS - 1))).otherwise(0)
    dealt = folded.join(sums.select(*keys, "low", "high"), keys).select(*keys, "v", "c", place.cast("int").alias("band"))
    counts = dealt.groupBy(*keys, "band").agg(F.sum("c").alias("c"))
    through = F.sum("c").over(Window.partitionBy(*keys).orderBy("band"))
    counts = counts.withColumn("through", through).withColumn("before", F.col("through") - F.col("c")).drop("c")
    shares = F.explode(F.array(*[F.lit(q) for q in (50, 90, 95, 99)])).alias("q")
    ranks = sums.select(*keys, "n", shares).withColumn("rank", F.greatest(F.lit(1), F.expr("(n * q + 99) DIV 100")))
    wanted = ranks.join(counts, keys).where("before < rank AND rank <= through").select(*keys, "q", "band", (F.col("rank") - F.col("before")).alias("rank"))
    inside = dealt.join(wanted.select(*keys, "band").distinct(), [*keys, "band"], "left_semi")
    inside = inside.withColumn("through", F.sum("c").over(Window.partitionBy(*keys, "band").orderBy("v")))
    found = wanted.join(inside.select(*keys, "band", "v", "through"), [*keys, "band"]).where("through >= rank").groupBy(*keys, "q").agg(F.min("v").alias("v"))
    named = found.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{q}") for q in (50, 90, 95, 99)])
    rows = sums.join(named, keys)
    return rows.select("k.*", "n", *[fixed(F.col(a), digits).alias(b) for a, b in (("low", "least"), ("high", "most"), ("mean", "mean"))], *[fixed(F.col(f"p{q}"), digits).alias(f"p{q}") for q in (50, 90, 95, 99)])


# Weights of a parameter sweep's quality score, in percent.
SWEEP_WEIGHTS = {"ndcg": 40, "recall": 25, "mrr": 20, "precision": 10, "quiet": 5}


def sweep_score(metrics: DataFrame, by: str = "variant") -> DataFrame:
    """by, queries, score: the weighted mean metrics of each variant (0 to 100)."""
    means = metrics.groupBy(by).agg(F.count(F.lit(1)).alias("queries"), *[fixed(F.avg(c)).alias(c) for c in ("ndcg", "recall", "mrr", "precision")], fixed(F.avg(1 - F.col("noise"))).alias("quiet"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in SWEEP_WEIGHTS.items()), F.lit(0.0))
    return means.select(by, "queries", fixed(total, 3).alias("score"))


# Weights of a whole sweep's quality score, and what a rate counts where it is missing.
QUALITY_WEIGHTS = {"pass_rate": (45.0, 0.0), "qa_page_hit": (12.5, 1.0), "compare_page_hit": (12.5, 1.0), "content_hit": (10.0, 1.0), "claim_support": (15.0, 1.0), "upload_resume": (5.0, 1.0)}
# The variants of a sweep, as settings changed from the defaults; the first five are the quick ones.
SWEEP_VARIANTS = {
    "baseline": {},
    "broad_topk": {"top_k": "8", "top_k_per_doc": "4"},
    "wide_overlap": {"chunk_overlap": "240"},
    "heuristic_rerank": {"rerank": "heuristic", "candidate_multiplier": "3", "rerank_weight": "0.7"},
    "hybrid_weighted": {"fusion": "weighted", "dense_weight": "0.55", "sparse_weight": "0.45", "sparse_top_k": "8"},
    "narrow_topk": {"top_k": "4", "top_k_per_doc": "2"},
    "narrow_overlap": {"chunk_overlap": "120"},
    "hybrid_rrf": {"fusion": "rrf", "rrf_k": "30", "sparse_top_k": "8"},
}
#: Judged routes in the order of a report; others follow by name.
ROUTES = ("qa", "compare", "abstain")


def quality_ranking(runs: DataFrame) -> DataFrame:
    """variant, quality, place of runs (variant, completed, the rates of QUALITY_WEIGHTS, response_ms,
    citations): by quality, then speed, then citations, then name. A run that failed has none."""
    total = sum((F.coalesce(c, F.lit(default)) * w for c, (w, default) in QUALITY_WEIGHTS.items()), F.lit(0.0))
    rows = runs.withColumn("quality", F.when(F.col("completed"), fixed(total)).otherwise(0.0))
    order = Window.orderBy(F.desc("quality"), F.asc_nulls_last("response_ms"), F.desc(F.coalesce("citations", F.lit(0.0))), "variant")  # one row a variant
    return rows.select("variant", "quality", F.row_number().over(order).alias("place"))


def judge_averages(cases: DataFrame, metrics: list[str], route_col: str = "route") -> DataFrame:
    """route, place, cases, and the mean of each metric over the cases that have it (null without)."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route")), F.lit(0)), F.lit(len(ROUTES) + 1))
    means = cases.groupBy(F.col(route_col).alias("route")).agg(F.count(F.lit(1)).alias("cases"), *[fixed(F.avg(m)).alias(m) for m in metrics])
    return means.withColumn("place", F.row_number().over(Window.orderBy(place, "route")))  # one row a route


def named_variants(spark, quick: bool = False) -> DataFrame:
    """variant, setting, value: the named variants' changed settings, null for the defaults."""
    chosen = list(SWEEP_VARIANTS.items())[: 5 if quick else None]
    rows = [(name, k, v) for name, changes in chosen for k, v in (changes or {None: None}).items()]
    return spark.createDataFrame(rows, "variant string, setting string, value string")


def sweep_variants(spark, **choices: list) -> DataFrame:
    """variant, and a column for each parameter: every combination of a few choices."""
    import itertools

    names = list(choices)
    rows = [("_".join(f"{n}={v}" for n, v in zip(names, values)), *values) for values in itertools.product(*choices.values())]
    return spark.createDataFrame(rows, ["variant", *names])
