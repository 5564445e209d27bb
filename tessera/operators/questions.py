"""Questions: intents, decomposition, safe external queries, lexical pair scores, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import clamp01, fixed, keyword_score
from tessera.functions.text import anchors, matches_anchor, normalize_search, normalize_whitespace, strip, term_set, terms

# How questions are split, and what names a topic or refers back to it.
SPLIT = r"(?i)\s+(?:and|also|plus|as well as)\s+|[;；]|以及|并且|同时|、"
TOPIC = r"(?i)\b(?:the\s+)?([a-z0-9][a-z0-9\s-]{1,70}?\b(?:policy|procedure|manual|handbook|guide|rule|rules|requirement|requirements|window|amount|ceiling|limit|limits))\b"
PRONOUN = r"(?i)\b(it|this|that|they|them)\b"
FILLER = r"(?i)^(?:(?:when|what|which|where|how|why|who|does|do|is|are|was|were|the|a|an)\s+)+"
COMPARISON = r"(?i)\b(compare|comparison|difference|differences|different|versus|vs|same|similar|conflict|conflicts|contrast|between|across)\b|区别|差异|不同|对比|比较|冲突|一致|相同"
ANALYSIS = r"(?i)\b(analy[sz]e|analysis|risk|risks|gaps?|exceptions?|uncertaint(?:y|ies)|obligations?|findings?)\b|分析|风险|缺口|例外|不确定|义务|发现"
TIMELINE = r"(?i)\b(timeline|chronology|when|deadline|deadlines|dates?|schedule)\b|时间线|日期|期限"
#: Results in all and per document, by intent.
INTENT_DEPTH = {"fact": (4, 2), "timeline": (9, 4), "comparison": (8, 4), "analysis": (10, 4)}


def intent(question: Column, documents: Column) -> Column:
    """timeline, comparison (of several documents), analysis, or fact."""
    return F.when(question.rlike(TIMELINE), "timeline").when((documents > 1) & question.rlike(COMPARISON), "comparison").when(question.rlike(ANALYSIS), "analysis").otherwise("fact")


def plan(questions: DataFrame) -> DataFrame:
    """query_id, intent, top_k, per_document. questions: query_id, query, documents (a number)."""
    kind = intent(F.coalesce("query", F.lit("")), F.col("documents"))
    depth = F.create_map(*[x for k, (a, b) in INTENT_DEPTH.items() for x in (F.lit(k), F.struct(F.lit(a).alias("top_k"), F.lit(b).alias("per_document")))])
    return questions.select("query_id", kind.alias("intent")).select("query_id", "intent", depth[F.col("intent")]["top_k"].alias("top_k"), depth[F.col("intent")]["per_document"].alias("per_document"))


def decompose(questions: DataFrame, most: int = 4) -> DataFrame:
    """query_id, part_no, part, is_primary: the question, then its parts where it has two or more.

    Parts without the question's topic get it: in place of a pronoun, else appended. Parts that
    agree as search text with an earlier one are dropped.
    """
    whole = normalize_whitespace(F.col("query"))
    topic = strip(F.regexp_replace(F.regexp_extract(whole, TOPIC, 1), FILLER, ""))
    tidy = lambda s: strip(F.regexp_replace(strip(s), r"[?？.。!！]+\z", ""))
    parts = F.filter(F.transform(F.split(whole, SPLIT), tidy), lambda s: F.size(terms(s)) > 0)
    rows = questions.where("query IS NOT NULL").select("query_id", whole.alias("query"), topic.alias("topic"), term_set(topic).alias("topic_terms"), parts.alias("parts"))

    def with_topic(s: Column) -> Column:
        there = (F.col("topic") == "") | F.arrays_overlap(term_set(s), F.col("topic_terms")) | (F.size("topic_terms") == 0)
        # only the first pronoun is replaced: what follows it stays
        pronoun = F.regexp_extract(s, PRONOUN, 1)
        at = F.position(pronoun, s)
        replaced = F.concat(F.substring(s, F.lit(1), at - 1), F.lit("the "), F.col("topic"), F.substring(s, at + F.length(pronoun), F.length(s)))
        return F.when(there, s).when(pronoun != "", replaced).otherwise(F.concat(s, F.lit(" for the "), F.col("topic")))

    several = F.when(F.size("parts") >= 2, F.slice(F.transform("parts", with_topic), 1, most)).otherwise(F.array().cast("array<string>"))
    listed = F.concat(F.array("query"), several)
    each = rows.select("query_id", F.posexplode(listed).alias("part_no", "part")).withColumn("key", normalize_search(F.col("part")))
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("part_no"))
    kept = each.where("key <> ''").withColumn("turn", first).where("turn = 1")
    return kept.select("query_id", "part_no", "part", (F.col("part_no") == 0).alias("is_primary"))


def external_queries(questions: DataFrame, sensitive: DataFrame, stop_words: list[str], most: int = 8) -> DataFrame:
    """query_id, safe_query, removed, reasons: terms that may leave the house.

    questions: query_id, query. sensitive: query_id, term. Terms go for the first reason that holds:
    unsafe form, generic, sensitive, or part of an internal code; the rest is kept once each, in
    order, up to `most`.
    """
    words = F.filter(F.split(F.lower(F.coalesce("query", F.lit(""))), r"[^\p{L}\p{N}_-]+"), lambda w: w != "")
    codes = F.flatten(F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(r"((?i)\b[a-z]{2,}[-_]?\d+(?:[-_][a-z0-9]+)*\b)"), F.lit(1)), lambda c: F.array_union(F.array(F.lower(c)), F.split(F.lower(c), "[-_]"))))
    rows = questions.select("query_id", codes.alias("codes"), F.posexplode_outer(words).alias("place", "term"))
    held = sensitive.select("query_id", F.lower("term").alias("term"), F.lit(True).alias("secret")).distinct()
    rows = rows.join(held, ["query_id", "term"], "left")
    reason = (
        F.when(F.col("term").isNull(), None)
        .when(~F.col("term").rlike(r"^[\p{L}][\p{L}\p{N}-]{2,40}$"), "unsafe_query_term")
        .when(F.col("term").isin(stop_words), "generic_or_restricted_term")
        .when(F.col("secret"), "sensitive_profile_term")
        .when(F.array_contains("codes", F.col("term")), "internal_identifier")
    )
    rows = rows.withColumn("reason", reason)
    first = F.min("place").over(Window.partitionBy("query_id", "term"))
    rows = rows.withColumn("fresh", F.col("reason").isNull() & F.col("term").isNotNull() & (F.col("place") == first))
    turn = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("turn", turn)
    kept = F.array_sort(F.collect_list(F.when(F.col("fresh") & (F.col("turn") <= most), F.struct("place", "term"))))
    grouped = rows.groupBy("query_id").agg(F.array_join(F.transform(kept, lambda x: x["term"]), " ").alias("safe_query"), F.count("reason").alias("removed"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return grouped


def lexical_pair_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: overlap, phrase, anchors, long terms."""
    wanted, held, body, asked = term_set(query), term_set(text), normalize_search(text), anchors(query)
    phrase = F.array_join(wanted, " ")
    hit = ((F.size(wanted) >= 2) & body.contains(phrase)) | (normalize_search(query).contains(" ") & body.contains(normalize_search(query))) | F.exists(asked, lambda a: body.contains(a["phrase"]))
    covered = F.when(F.size(asked) > 0, F.size(F.filter(asked, lambda a: matches_anchor(a, body, held))) / F.size(asked)).otherwise(0.0)
    rare = F.size(F.filter(F.array_intersect(wanted, held), lambda t: F.length(t) >= 6)) / F.greatest(F.lit(1), F.size(wanted))
    overlap = F.coalesce(keyword_score(wanted, held), F.lit(0.0))
    return clamp01(overlap * 0.45 + F.when(hit, 0.25).otherwise(0.0) + covered * 0.2 + rare * 0.1)


# What a question may ask for besides its topic.
ASKS_TIME = r"(?i)\b(when|deadline|date|how long|how soon|period)\b|何时|多久|期限"
ASKS_NUMBER = r"(?i)\b(how many|how much|amount|limit|maximum|minimum|number of|percentage|rate|cost)\b|多少|金额|比例"
HAS_TIME = r"(?i)\b\d+\s*(?:day|week|month|year|hour|minute)s?\b|\b\d{4}-\d{2}-\d{2}\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"


def gaps(questions: DataFrame, evidence: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """query_id, requirement, status (covered, partial, missing): the best evidence decides.

    The topic is covered at 0.6 of its terms, partly at 0.25; each anchor by its phrase or all its
    terms, partly by some; time and number only if asked for, by evidence that has one.
    """
    asked = questions.select("query_id", term_set(F.col("query")).alias("wanted"), anchors(F.col("query")).alias("asked"), F.col("query").rlike(ASKS_TIME).alias("time"), F.col("query").rlike(ASKS_NUMBER).alias("number"))
    found = evidence.select("query_id", F.col(text_col).alias("t"), term_set(F.col(text_col)).alias("held"), normalize_search(F.col(text_col)).alias("body"))
    rows = asked.join(found, "query_id", "left")
    share = F.coalesce(keyword_score(F.col("wanted"), F.col("held")), F.lit(0.0))
    level = lambda full, part: F.when(F.coalesce(full, F.lit(False)), 2).when(F.coalesce(part, F.lit(False)), 1).otherwise(0)
    some = lambda a: F.arrays_overlap(a["terms"], F.col("held"))
    one = lambda name, grade: F.struct(name.alias("requirement"), grade.alias("grade"))
    needs = F.concat(
        F.when(F.size("wanted") > 0, F.array(one(F.lit("topic"), level(share >= 0.6, share >= 0.25)))).otherwise(F.array().cast("array<struct<requirement:string,grade:int>>")),
        F.transform("asked", lambda a: one(F.concat(F.lit("anchor:"), a["phrase"]), level(matches_anchor(a, F.col("body"), F.col("held")), some(a)))),
        F.when(F.col("time"), F.array(one(F.lit("time"), level(F.col("t").rlike(HAS_TIME), F.lit(False))))).otherwise(F.array().cast("array<struct<requirement:string,grade:int>>")),
        F.when(F.col("number"), F.array(one(F.lit("number"), level(F.col("t").rlike(r"\d"), F.lit(False))))).otherwise(F.array().cast("array<struct<requirement:string,grade:int>>")),
    )
    best = rows.select("query_id", F.explode(needs).alias("n")).groupBy("query_id", F.col("n.requirement").alias("requirement")).agg(F.max("n.grade").alias("grade"))
    return best.select("query_id", "requirement", F.when(F.col("grade") == 2, "covered").when(F.col("grade") == 1, "partial").otherwise("missing").alias("status"))


def topic_phrases(profiles: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, phrase, weight: phrases of one to three words by tag and summary weights.

    profiles: doc_id, tags (array, best first), summary. A tag weighs 8 less 0.15 for each place; a
    summary phrase of n words 0.8 (one word) or 1.35 n, plus 0.6 (n - 1) and 1 / (place + 1).
    """
    tags = profiles.select("doc_id", F.posexplode("tags").alias("i", "phrase")).select("doc_id", "phrase", (F.lit(8.0) - F.col("i") * 0.15).alias("w"))
    words = profiles.select("doc_id", terms(F.col("summary")).alias("words"))
    grams = None
    for n in (1, 2, 3):
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: i + n - 1 <= F.size("words"))
        one = words.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("i", "phrase"))
        one = one.select("doc_id", "phrase", (F.lit(0.8 if n == 1 else 1.35 * n) + 0.6 * (n - 1) + F.lit(1.0) / (F.col("i") + 1)).alias("w"))
        grams = one if grams is None else grams.unionByName(one)
    summed = tags.unionByName(grams).groupBy("doc_id", "phrase").agg(fixed(F.sum("w"), 6).alias("weight"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "phrase"))).where(F.col("place") <= most).select("doc_id", "phrase", "weight")
