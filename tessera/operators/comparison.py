"""Comparing the evidence of documents: near-duplicates, numeric and modality conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import fixed, jaccard, overlap
from tessera.functions.text import NUMBER, SENTENCE_END, canonical_sentences, normalize_number, normalize_whitespace, numeric_tokens, strip, term_set

# Thresholds on term Jaccard and sentence overlap.
NEAR, STRONG = (0.75, 0.6), (0.85, 0.75)
# Patterns that tell what a text demands or allows.
REQUIRE = r"(?i)\b(?:require(?:d|s|ing)?|must|mandatory|mandate(?:d|s|ing)?|need(?:ed|s|ing)?|necessary)\b"
OPTIONAL = r"(?i)\b(?:optional|unnecessary|not\s+(?:required|necessary|mandatory)|does?\s+not\s+require|independent(?:ly)?\s+of|free\s+from|exempt(?:ed)?\s+from)\b"
ALLOW = r"(?i)\b(?:allow(?:ed|s|ing)?|permit(?:s|ted|ting)?|may)\b"
PROHIBIT = r"(?i)\b(?:prohibit(?:ed|s|ing)?|forbid(?:s|den|ding)?|disallow(?:ed|s|ing)?|not\s+(?:allowed|permitted)|cannot|can't|must\s+not|may\s+not)\b"


def signals(text: Column) -> Column:
    """Which of require, optional, allow, prohibit the text signals."""
    optional, prohibit = text.rlike(OPTIONAL), text.rlike(PROHIBIT)
    found = [("require", text.rlike(REQUIRE) & ~optional), ("optional", optional), ("allow", text.rlike(ALLOW) & ~prohibit), ("prohibit", prohibit)]
    return F.array_compact(F.array(*[F.when(yes, F.lit(name)) for name, yes in found]))


def numeric_bindings(text: Column) -> Column:
    """Distinct (sentence with <num>, its numbers in order joined by |), of sentences with numbers."""
    pieces = F.split(normalize_whitespace(text), SENTENCE_END)
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1)), normalize_number)
    canonical = lambda s: strip(F.regexp_replace(F.regexp_replace(F.lower(s), NUMBER, "<num>"), r"\s+", " "))
    bound = F.transform(pieces, lambda s: F.struct(canonical(s).alias("sentence"), F.array_join(numbers(s), "|").alias("numbers")))
    return F.array_distinct(F.filter(bound, lambda b: b["numbers"] != ""))


def evidence_features(evidence: DataFrame, by: tuple[str, ...] = ("group_id", "doc_id"), text_col: str = "text") -> DataFrame:
    """One row per document of a group, with what pairs are judged by. evidence: by, text."""
    text = F.col(text_col)
    return evidence.select(
        *by,
        term_set(text).alias("terms"),
        canonical_sentences(text).alias("sentences"),
        numeric_tokens(text).alias("numbers"),
        numeric_bindings(text).alias("bindings"),
        signals(text).alias("signals"),
        (normalize_whitespace(text) != "").alias("comparable"),
    )


def _opposed(a: Column, b: Column) -> Column:
    has = F.array_contains
    pairs = [("require", "optional"), ("optional", "require"), ("allow", "prohibit"), ("prohibit", "allow")]
    out = F.lit(False)
    for x, y in pairs:
        out = out | (has(a, x) & has(b, y))
    return out


def _binding_conflict(a: Column, b: Column) -> Column:
    """A sentence both have is bound to different sets of numbers."""
    of = lambda xs, s: F.array_sort(F.transform(F.filter(xs, lambda x: x["sentence"] == s), lambda x: x["numbers"]))
    return F.exists(a, lambda x: (F.size(of(b, x["sentence"])) > 0) & (of(a, x["sentence"]) != of(b, x["sentence"])))


def analyse_pairs(features: DataFrame, group: str = "group_id") -> DataFrame:
    """Each pair of comparable documents of a group (left id below right id) with its verdicts.

    A group is the selection of one question, a handful of documents; pairs are taken within it.
    """
    rows = features.where("comparable")
    left = rows.select(group, *[F.col(c).alias(f"l_{c}") for c in rows.columns if c != group])
    right = rows.select(group, *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != group])
    pairs = left.join(right, group).where("l_doc_id < r_doc_id")
    col = F.col
    near = lambda bars: (jaccard(col("l_terms"), col("r_terms")) >= bars[0]) & (overlap(col("l_sentences"), col("r_sentences")) >= bars[1])
    same = lambda c: F.array_sort(col(f"l_{c}")) == F.array_sort(col(f"r_{c}"))
    only_left, only_right = (F.array_sort(F.array_except(f"{x}_numbers", f"{y}_numbers")) for x, y in (("l", "r"), ("r", "l")))
    out = pairs.select(
        group,
        col("l_doc_id").alias("left_doc"),
        col("r_doc_id").alias("right_doc"),
        fixed(jaccard(col("l_terms"), col("r_terms"))).alias("term_jaccard"),
        fixed(overlap(col("l_sentences"), col("r_sentences"))).alias("sentence_overlap"),
        near(NEAR).alias("near_duplicate"),
        near(STRONG).alias("strong_near_duplicate"),
        (same("sentences") & same("numbers") & same("bindings")).alias("exact_match"),
        _binding_conflict(col("l_bindings"), col("r_bindings")).alias("binding_conflict"),
        _opposed(col("l_signals"), col("r_signals")).alias("modality_conflict"),
        F.array_join(only_left, "|").alias("only_left"),
        F.array_join(only_right, "|").alias("only_right"),
    )
    conflict = (col("only_left") != "") | (col("only_right") != "") | col("binding_conflict") | col("modality_conflict")
    return out.withColumn("explicit_conflict", col("near_duplicate") & conflict)


def verdicts(pairs: DataFrame, selected: DataFrame, group: str = "group_id") -> DataFrame:
    """Per group: documents, missing, pairs, conflicts, no_difference (all match, none conflicts or is missing).

    selected: group, doc_id, results (how many pieces of evidence; 0 for a missing document).
    """
    found = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("explicit_conflict").alias("conflicts"), F.bool_and(F.col("exact_match") & ~F.col("explicit_conflict")).alias("all_match"))
    chosen = selected.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("results") == 0).alias("missing"), (F.max("results") - F.min("results") > 1).alias("skewed"))
    rows = chosen.join(found, group, "left")
    balance = F.when(F.col("skewed"), "skewed").otherwise("balanced")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = (F.col("missing") == 0) & F.coalesce("all_match", F.lit(False))
    return rows.select(group, "documents", "missing", zero("pairs"), zero("conflicts"), balance.alias("balance"), none.alias("no_difference"))


def source_bundle(results: DataFrame, documents: int, group: str = "group_id", text_col: str = "text") -> DataFrame:
    """Sources of a comparison: the best hit of each document, then at most one further hit each.

    results: group, doc_id, chunk_index, score, text. Further hits are weighed by what they add:
    6 for each number and 3 for each sentence that no other document has, less half for each shared
    one; at most min(8, 2 * documents) sources in all. Columns: group, source_rank, doc_id,
    chunk_index, role.
    """
    per_document = Window.partitionBy(group, "doc_id").orderBy(F.desc("score"), "chunk_index")
    rows = results.withColumn("place", F.row_number().over(per_document)).withColumns({"numbers": numeric_tokens(F.col(text_col)), "sentences": canonical_sentences(F.col(text_col))})
    each = rows.select(group, "doc_id", "chunk_index", F.explode(F.concat(F.transform("numbers", lambda n: F.concat(F.lit("n"), n)), F.transform("sentences", lambda s: F.concat(F.lit("s"), s)))).alias("item"))
    owners = each.groupBy(group, "item").agg(F.count_distinct("doc_id").alias("owners"))
    worth = F.when(F.col("owners") == 1, F.when(F.col("item").startswith("n"), 6.0).otherwise(3.0)).when(F.col("item").startswith("s"), -0.5).otherwise(0.0)
    weights = each.join(owners, [group, "item"]).groupBy(group, "doc_id", "chunk_index").agg(F.sum(worth).alias("adds"))
    rows = rows.join(weights, [group, "doc_id", "chunk_index"], "left").withColumn("value", F.coalesce("adds", F.lit(0.0)) + F.col("score") * 0.01 - (F.col("place") - 1) * 0.1)
    extra_order = Window.partitionBy(group, "doc_id").orderBy(F.desc("value"), "chunk_index")
    best = rows.where("place = 1").select(group, "doc_id", "chunk_index", "score", F.lit("best").alias("role"), F.col("score").alias("value"))
    extra = rows.where("place > 1").withColumn("pick", F.row_number().over(extra_order)).where("pick = 1").select(group, "doc_id", "chunk_index", "score", F.lit("extra").alias("role"), "value")
    order = Window.partitionBy(group).orderBy("role", F.desc("value"), "doc_id")
    chosen = best.unionByName(extra).withColumn("source_rank", F.row_number().over(order))
    return chosen.where(F.col("source_rank") <= min(8, 2 * documents)).select(group, "source_rank", "doc_id", "chunk_index", "role")


def entailment(evidence: DataFrame, group: str = "group_id", text_col: str = "text") -> DataFrame:
    """group, left_doc, right_doc, left_by_right, right_by_left: every sentence of one is supported
    by the other, as a claim by its source. evidence: group, doc_id, text."""
    from tessera.operators.verify import check_claims, claims

    docs = evidence.where(F.col(text_col).isNotNull())
    pairs = docs.select(group, F.col("doc_id").alias("said"), F.col(text_col).alias("said_text")).join(docs.select(group, F.col("doc_id").alias("source"), F.col(text_col).alias("source_text")), group).where("said <> source")
    pairs = pairs.withColumn("answer_id", F.concat_ws("|", group, "said", "source"))
    found = claims(pairs.select("answer_id", F.col("said_text").alias("text")))
    checked = check_claims(found, pairs.select("answer_id", F.lit(1).alias("rank"), F.col("source").alias("doc_id"), F.col("source_text").alias("text")))
    whole = checked.groupBy("answer_id").agg(F.bool_and("supported").alias("entailed"))
    rows = pairs.select(group, "said", "source", "answer_id").join(whole, "answer_id", "left").withColumn("entailed", F.coalesce("entailed", F.lit(False)))
    left, right = F.least("said", "source"), F.greatest("said", "source")
    return rows.groupBy(group, left.alias("left_doc"), right.alias("right_doc")).agg(
        F.bool_or((F.col("said") < F.col("source")) & F.col("entailed")).alias("left_by_right"), F.bool_or((F.col("said") > F.col("source")) & F.col("entailed")).alias("right_by_left")
    )


def diagnostics(pairs: DataFrame, group: str = "group_id") -> DataFrame:
    """group, left_doc, right_doc, line: what an analysis found about a pair, in words."""
    verdict = F.when(F.col("explicit_conflict"), "explicit conflict").when(F.col("exact_match"), "same evidence").when(F.col("strong_near_duplicate"), "strong near-duplicate").when(F.col("near_duplicate"), "near-duplicate").otherwise("different evidence")
    numbers = F.concat_ws("; ", F.when(F.col("only_left") != "", F.concat(F.lit("only left: "), "only_left")), F.when(F.col("only_right") != "", F.concat(F.lit("only right: "), "only_right")))
    line = F.concat_ws("; ", verdict, F.format_string("term Jaccard %.4f", "term_jaccard"), F.format_string("sentence overlap %.4f", "sentence_overlap"), F.nullif(numbers, F.lit("")))
    return pairs.select(group, "left_doc", "right_doc", line.alias("line"))


def comparison_answers(verdict: DataFrame, pairs: DataFrame, group: str = "group_id") -> DataFrame:
    """group, text: a grounded sentence for each group: no difference, conflicts, or neither."""
    conflicts = pairs.where("explicit_conflict").select(group, F.struct("left_doc", "right_doc", F.concat(F.lit("Documents "), "left_doc", F.lit(" and "), "right_doc", F.lit(" conflict"), F.when((F.col("only_left") != "") | (F.col("only_right") != ""), F.concat(F.lit(" ("), F.coalesce(F.nullif("only_left", F.lit("")), F.lit("none")), F.lit(" against "), F.coalesce(F.nullif("only_right", F.lit("")), F.lit("none")), F.lit(")"))).otherwise(""), F.lit(".")).alias("s")).alias("c"))
    said = conflicts.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["s"]), " ").alias("said"))
    rows = verdict.join(said, group, "left")
    text = F.when(F.col("no_difference"), F.lit("The documents show no material difference.")).when(F.col("said").isNotNull(), F.col("said")).when(F.col("missing") > 0, F.lit("Some documents gave no evidence to compare.")).otherwise("The evidence differs without an explicit conflict.")
    return rows.select(group, text.alias("text"))
