"""URL filter: stated rules first, then association rules mined by FP-growth.

URL tokens (host labels, top-level domain, path words, file extension, query keys) of labelled pages
are transactions. A rule is a token combination whose share of blocked pages reaches a confidence,
and whose blocked pages reach a support; a URL is blocked when it holds all tokens of a rule. Rules
of every length count. What can't change a verdict is left out before it is mined:
  1. a token that is a rule by itself: whatever holds it is blocked, so longer rules with it are
     implied. Only the other tokens that reach the support go on;
  2. tokens that occur in just the same labelled pages (all parts of one template, say) count as
     one, as combinations of them double with each; a rule with one of them holds for each;
  3. FP-growth mines the combinations of the blocked pages alone; their counts over all labelled
     pages, for the confidence, are found by the same inverted index that judges URLs.
Rules that a shorter one implies are dropped. The index lists each rule under the tokens of its
rarest part. With t different tokens a page left after 1 and 2 and least support s, a page adds at
most 2**t combinations, and there are at most sum C(t, i) / s in all, whatever the number of pages;
max_terms bounds i where t is large. Spark decides by the measured size whether to broadcast them.

Defined results: a null URL or one without :// has an empty host and path, no tokens, no rule,
and is allowed; repeated rows each get the same verdict; empty tables give empty results; with no
labels, or with fewer than min_count blocked ones, nothing is mined and only stated rules block (a
rule needs min_count blocked pages at any size).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BLOCK = "label=block"

#: (verdict, host, path prefix)
STATED_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PATTERN, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, top-level domain (the last label), path words, extension, query keys."""
    labels = F.filter(F.split(F.regexp_replace(host, r"(^|\.)[^.]*$", ""), r"\."), lambda x: x != "")
    words = F.filter(F.split(path, r"[/._\-]"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    top = F.transform(F.filter(F.array(F.element_at(F.split(host, r"\."), -1)), lambda x: x != ""), lambda x: F.concat(F.lit("top="), x))
    return F.array_distinct(F.coalesce(F.concat(named("host=", labels), top, named("path=", words), named("key=", keys)), F.array().cast("array<string>")))


def holds_all(parts: str, tokens: str) -> Column:
    """Does the array of tokens hold one of each part's alternatives?"""
    return F.forall(parts, lambda alternatives: F.arrays_overlap(alternatives, tokens))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, max_terms: int | None, min_count: int) -> DataFrame:
    """Rules (parts: arrays of alternative tokens, of which a URL needs one each; keys: those of the
    rarest part; confidence, support) for blocking, from rows (tokens, blocked boolean)."""
    labelled = checkpointed(labelled)
    sums = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("blocked").cast("int")), F.lit(0))).first()
    least = max(min_count, min_support * sums[0])
    # tokens, and a sum of hashes that tells which rows hold them
    place = F.xxhash64("tokens", "blocked").cast("decimal(38,0)")
    each = labelled.select(F.explode("tokens").alias("token"), "blocked", place.alias("place"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("int")).alias("bad"), F.sum("place").alias("place")).where(F.col("bad") >= least)
    counts = checkpointed(counts)
    confident = F.col("bad") / F.col("n") >= min_confidence
    alone = counts.where(confident).select(F.array(F.array("token")).alias("parts"), F.array("token").alias("keys"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / sums[0]).alias("support"))
    kinds = checkpointed(counts.where(~confident).groupBy("n", "bad", "place").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(F.element_at("tokens", 1).alias("kind"), "tokens", "n"))
    members = kinds.select("kind", F.explode("tokens").alias("token"))
    bad = labelled.where("blocked").withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token")).join(members, "token").groupBy("row").agg(F.collect_set("kind").alias("items"))
    bad = checkpointed(bad.select("items"))
    many = bad.count()
    if many < least:
        return alone
    found = FPGrowth(itemsCol="items", minSupport=least / many).fit(bad).freqItemsets.where((F.size("items") > 1) & (F.col("freq") >= least))
    if max_terms is not None:
        found = found.where(F.size("items") <= max_terms)
    found = found.select(F.array_sort("items").alias("items"), F.col("freq").alias("bad"))
    parts = found.select("items", "bad", F.explode("items").alias("kind")).join(kinds, "kind")
    parts = checkpointed(parts.groupBy("items", "bad").agg(F.collect_list("tokens").alias("parts"), F.min_by("tokens", F.struct("n", "kind")).alias("keys")))
    rows = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))  # equal token sets are looked up once
    met = rows.select("tokens", "n", F.explode("tokens").alias("key")).join(parts.select("items", "parts", F.explode("keys").alias("key")), "key").where(holds_all("parts", "tokens"))
    # a URL may hold several of the keys
    total = met.dropDuplicates(["tokens", "items"]).groupBy("items").agg(F.sum("n").alias("n"))
    rules = checkpointed(parts.join(total, "items").where(F.col("bad") / F.col("n") >= min_confidence))
    shorter = rules.select(F.explode("items").alias("kind"), F.col("items").alias("within"))
    longer = rules.select("items", F.explode("items").alias("kind")).join(shorter, "kind").where((F.size("within") < F.size("items")) & (F.size(F.array_except("within", "items")) == 0))
    rules = rules.join(longer.select("items").distinct(), "items", "left_anti")
    return alone.unionByName(rules.select("parts", "keys", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / sums[0]).alias("support")))


def filter_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    rules: list[tuple[str, str, str]] = STATED_RULES,
    min_support: float = 0.005,
    min_confidence: float = 0.8,
    max_terms: int | None = None,
    min_count: int = 10,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    labels has page_id and blocked (boolean); a page that a stated rule judges is labelled by that
    rule. Pages are matched by (page_id, url), so one URL on many pages is spread over tasks.
    """
    url = F.col("url")
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": url_host(url), "path": url_path(url)})
    rule, stated = stated_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "stated": stated})
    tokens = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens(url, F.col("host"), F.col("path")))
    if labels is None:
        labelled = base.where("stated IS NOT NULL").select(tokens.alias("tokens"), (F.col("stated") == "block").alias("blocked"))
    else:
        known = labels.select("page_id", "blocked").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
        labelled = (
            base.join(known, "page_id", "left")
            .select(tokens.alias("tokens"), F.coalesce(F.col("stated") == "block", F.col("blocked")).alias("blocked"))
            .where("blocked IS NOT NULL")
        )
    mined = checkpointed(mine_rules(labelled, min_support, min_confidence, max_terms, min_count))
    seen = base.where("stated IS NULL").select("page_id", "url", tokens.alias("tokens")).dropDuplicates(["page_id", "url"])
    hit = (
        seen.select("page_id", "url", "tokens", F.explode("tokens").alias("key"))
        .join(mined.select("parts", F.explode("keys").alias("key")), "key")
        .where(holds_all("parts", "tokens"))
        .select(F.col("page_id").alias("hit_id"), F.col("url").alias("hit_url"), F.lit("block").alias("mined"))
        .dropDuplicates(["hit_id", "hit_url"])
    )
    return base.join(hit, F.col("page_id").eqNullSafe(F.col("hit_id")) & F.col("url").eqNullSafe(F.col("hit_url")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("stated", "mined", F.lit("allow")).alias("verdict")
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; labels of quality 0 mark pages of the same id as to be blocked."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    return filter_urls(table(spark, sf_dir, "pages"), labels)


QUERIES = {"op7_url_rules": op7_url_rules}
ORACLES: dict[str, str] = {}
