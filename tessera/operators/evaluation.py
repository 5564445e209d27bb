"""Judging answers of an evaluation run: matches, coverage, verdicts, divergence between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip

# English number words below a hundred, and phrases by which an answer abstains.
UNITS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["zero", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ABSTENTIONS = [
    "couldn't find enough grounded evidence",
    "comparison would be unreliable",
    "selected documents, so the comparison would be unreliable",
    "uploaded documents to answer reliably",
]
NUMBER_WORDS = {w: n for n, w in enumerate(UNITS, 1)} | {w: (0 if w == "zero" else 9 + n) for n, w in enumerate(TEENS)} | {w: 10 * n for n, w in enumerate(TENS, 2)}


def match_form(text: Column) -> Column:
    """Lower case, thousands separators dropped, number words as digits, white space collapsed.

    Each number word becomes marked digits; marked tens and units beside each other are joined.
    """
    out = F.regexp_replace(F.lower(text), r"(\d),(\d)", "$1$2")
    for word, n in NUMBER_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", f"\x01{n}\x02")
    out = F.regexp_replace(out, "\x01([2-9])0\x02[-\\s]+\x01([1-9])\x02", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(out, "[\x01\x02]", ""), r"\s+", " "))


def contains_all(answer: Column, fragments: Column) -> Column:
    """Every expected fragment occurs in the answer; true where none is expected."""
    normal = match_form(answer)
    return F.coalesce(F.forall(fragments, lambda f: normal.contains(match_form(f))), F.lit(True))


def abstains(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for phrase in ABSTENTIONS:
        out = out | low.contains(phrase)
    return out


def coverage(cases: DataFrame, citations: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, doc_hit, page_hit: all expected documents (and pages) are cited.

    cases: case_id. citations and expected: case_id, doc_key, page_number; an expected page of null
    means any page. A case that expects nothing is hit when nothing is cited.
    """
    docs = citations.select("case_id", "doc_key").distinct().withColumn("cited", F.lit(True))
    pages = citations.select("case_id", "doc_key", "page_number").distinct().withColumn("page_cited", F.lit(True))
    units = expected.join(docs, ["case_id", "doc_key"], "left").join(pages, ["case_id", "doc_key", "page_number"], "left")
    by_document = units.groupBy("case_id", "doc_key").agg(F.bool_or(F.coalesce("cited", F.lit(False))).alias("doc"), F.bool_or(F.coalesce("page_cited", F.col("page_number").isNull() & F.col("cited"), F.lit(False))).alias("page"))
    hits = by_document.groupBy("case_id").agg(F.bool_and("doc").alias("doc_hit"), F.bool_and("page").alias("page_hit"))
    cited = citations.select("case_id").distinct().withColumn("any", F.lit(True))
    rows = cases.select("case_id").join(hits, "case_id", "left").join(cited, "case_id", "left")
    return rows.select("case_id", F.coalesce("doc_hit", F.col("any").isNull()).alias("doc_hit"), F.coalesce("page_hit", F.col("any").isNull()).alias("page_hit"))


def case_passed(should_abstain: Column, abstained: Column, has_text: Column, doc_hit: Column, page_hit: Column, content_hit: Column, supported: Column) -> Column:
    """An abstaining case must abstain; another must answer, with its content and support."""
    base = has_text & doc_hit & page_hit
    return F.when(should_abstain, abstained & base).otherwise(~abstained & base & content_hit & supported)


def comparison_expectation(expected: Column, abstained: Column, no_difference_claims: Column, difference_claims: Column, difference_documents: Column) -> tuple[Column, Column]:
    """passed and reason of a comparison case that expects no_difference, difference or abstain."""
    none, some, cross = no_difference_claims > 0, difference_claims > 0, difference_documents >= 2
    alike = F.when(abstained, "unexpected_abstention").when(some, "supported_substantive_difference_present").when(~none, "missing_supported_no_difference_verdict").otherwise("ok")
    apart = F.when(abstained, "unexpected_abstention").when(none, "supported_no_difference_verdict_present").when(~cross, "missing_supported_cross_document_difference").otherwise("ok")
    silent = F.when(abstained, "ok").otherwise("missing_required_abstention")
    reason = F.when(expected == "no_difference", alike).when(expected == "difference", apart).when(expected == "abstain", silent).otherwise("not_applicable")
    return reason.isin("ok", "not_applicable"), reason


def divergence(actual: DataFrame, compared: DataFrame, key: str = "case_id", signature: str = "signature") -> DataFrame:
    """key, reason of every case that only one run has, or whose signatures differ (null-safe)."""
    left = actual.select(key, F.col(signature).alias("a"), F.lit(True).alias("in_a"))
    right = compared.select(key, F.col(signature).alias("b"), F.lit(True).alias("in_b"))
    rows = left.join(right, key, "full_outer")
    reason = F.when(F.col("in_b").isNull(), "missing_compare_case").when(F.col("in_a").isNull(), "missing_provider_case").when(~F.col("a").eqNullSafe(F.col("b")), "planner_signature_mismatch")
    return rows.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def fallback_rates(cases: DataFrame) -> DataFrame:
    """cases, fallbacks, unexpected, unexpected_rate. cases: fallback, expected_fallback (booleans)."""
    from tessera.functions.scores import fixed

    unexpected = F.col("fallback") & ~F.coalesce("expected_fallback", F.lit(False))
    sums = cases.agg(F.count(F.lit(1)).alias("cases"), F.count_if("fallback").alias("fallbacks"), F.count_if(unexpected).alias("unexpected"))
    return sums.withColumn("unexpected_rate", F.when(F.col("cases") > 0, fixed(F.col("unexpected") / F.col("cases"))).otherwise(0.0))


def evidence_gaps(verdicts: DataFrame) -> DataFrame:
    """answer_id, gap_no, gap of the verdicts' reasons, in order."""
    rows = verdicts.where("reasons <> ''").select("answer_id", F.posexplode(F.split("reasons", ",")).alias("gap_no", "gap"))
    return rows


def remembered_claims(checked: DataFrame, by: str = "answer_id") -> DataFrame:
    """by, key, supported: each distinct claim once; a supported form evicts unsupported ones."""
    key = F.lower(strip(F.regexp_replace("claim", r"\s+", " ")))
    return checked.select(by, key.alias("key"), "supported").where("key <> ''").groupBy(by, "key").agg(F.bool_or("supported").alias("supported"))


def feedback_cases(feedback: DataFrame) -> DataFrame:
    """Failed answers as regression cases: question, kind, reports, documents (distinct, in order).

    feedback: question, kind, doc_ids (array). One case for each question and kind.
    """
    rows = feedback.where(F.coalesce(strip(F.col("question")), F.lit("")) != "").select(F.lower(strip(F.regexp_replace("question", r"\s+", " "))).alias("question"), "kind", "doc_ids")
    counted = rows.groupBy("question", "kind").agg(F.count(F.lit(1)).alias("reports"))
    each = rows.select("question", "kind", F.explode_outer("doc_ids").alias("doc_id"))
    listed = each.groupBy("question", "kind").agg(F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("documents"))
    return counted.join(listed, ["question", "kind"])


def reference_contexts(expected: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, doc_key, page_number, text: the expected pages; all of a document's where none is named."""
    named = expected.where("page_number IS NOT NULL").join(pages, ["doc_key", "page_number"])
    whole = expected.where("page_number IS NULL").drop("page_number").join(pages, "doc_key")
    return named.select("case_id", "doc_key", "page_number", "text").unionByName(whole.select("case_id", "doc_key", "page_number", "text")).distinct()
