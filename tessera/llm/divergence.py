"""How sources of one language differ in their terms: inclusion and exclusion over supports.

The value of two groups is a sum over all kept terms of the language, of which most occur in one of the
two or in neither. With z the share of a term that a group doesn't have, and f(p, q) its value,

    sum f = sum over terms of A of f(p, z_B)  +  sum over terms of B of f(z_A, q)
          + (V - |A| - |B|) f(z_A, z_B)
          + sum over terms of both of f(p, q) - f(p, z_B) - f(z_A, q) + f(z_A, z_B).

The one-sided sums depend on counts only, so they are priced on each group's histogram of counts; the
third is one constant; only the last needs terms, those that both groups have: a join of the sparse
counts with themselves by term, summed in each task before it is shuffled. Sums are exact, in
64-bit integers; shares are divided in 38 digits.

Counting: a task counts terms by language and source in dictionaries of bounded size, so that a very
frequent term or a very large source leaves it as few rows; these are dealt by language and term, once,
for all later steps. A term's own rows are one for each source at most; the pairs of a term are pairs of
sources, which the result holds anyway.

Defined results: null texts, languages and sources count as empty; rows of one id are documents of their
own; a group without terms has all pairs and no terms; a language without kept terms has pairs of value
0; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.terms import BEYOND_ASCII, LETTERS, folding, term_lists, text_column
from tessera.llm.words import slices

TERM_BYTES = folding(LETTERS + LETTERS.upper() + BEYOND_ASCII)
#: Terms by group that a task holds before it hands their counts on.
HELD = 300_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, documents: counts of terms, several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, documents) in counts.items():
                n = len(times)
                if n:
                    terms = pa.array(list(times), pa.binary()).cast(pa.string())
                    numbers = [pa.array(list(times.values()), pa.int64()), pa.array([documents[t] for t in times], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), terms, *numbers], ["lang", "source", "term", "n", "documents"])

        for batch in (part for whole in batches for part in slices(whole)):
            for lang, source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_column(batch.column(0))):
                times, documents = counts.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in term_lists(text, TERM_BYTES):
                    times.update(words)
                    seen.update(words)
                documents.update(seen)
            if sum(len(times) for times, _ in counts.values()) > HELD:
                yield from handed_on()
                counts = {}
        yield from handed_on()

    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, documents long")


def kept_counts(docs: DataFrame, least_documents: int) -> DataFrame:
    """lang, term, source, n, all_n: counts above 0 of the terms in enough documents of their language."""
    dealt = term_counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = Window.partitionBy("lang", "term")
    whole = by_source.select("lang", "term", "source", "n", F.sum("documents").over(by_term).alias("held"), F.sum("n").over(by_term).alias("all_n"))
    return whole.where(F.col("held") >= least_documents).drop("held")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return 1 + F.call_function("div", wide(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), wide(total + 2 * kinds))


def value(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_documents: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: the value of each other source of the language against the group. Part term: the top
    terms that the group has and uses more than its language does.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = docs.select(blank(text_col).alias("text"), blank(lang_col).alias("lang"), blank(source_col).alias("source"))
    kept = stored(kept_counts(base, least_documents))
    kinds = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    groups = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0)
    groups = stored(groups.withColumn("none", F.when(F.col("kinds") > 0, share(F.lit(0), F.col("total"), F.col("kinds"))).otherwise(0)))
    return pair_values(kept, groups).unionByName(top_terms(kept, groups, top))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    one = groups.select("lang", "source", "total", "support", "kinds", "none")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("support").alias("other_support"))
    # what each group's own terms are worth against groups that don't have them
    histogram = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")).join(one, ["lang", "source"])
    priced = histogram.select("lang", "source", "terms", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"))
    sided = (
        priced.join(other, "lang").where(F.col("source") != F.col("item"))
        .groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * value(F.col("p"), F.col("other_none"))).alias("worth"))
    )
    either = sided.select("lang", "source", "item", "worth").unionByName(sided.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "worth"))
    # what terms of both are worth, less what was counted for them on either side
    shares = kept.join(one, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), "none")
    left, right = shares.alias("a"), shares.alias("b")
    p, q, y, z = F.col("a.p"), F.col("b.p"), F.col("a.none"), F.col("b.none")
    both = (
        left.join(right, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
        .groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"))
        .agg(F.sum(value(p, q) - value(p, z) - value(y, q) + value(y, z)).alias("worth"))
    )
    either = either.unionByName(both).unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "worth"))
    worth = either.groupBy("lang", "source", "item").agg(F.sum("worth").alias("worth"))
    neither = F.when(F.col("kinds") > 0, (F.col("kinds") - F.col("support") - F.col("other_support")) * value(F.col("none"), F.col("other_none"))).otherwise(0)
    pairs = one.join(other, "lang").where(F.col("source") != F.col("item")).join(worth, ["lang", "source", "item"], "left")
    valued = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("worth", F.lit(0)) + neither).cast("long").alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def top_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("kinds")).alias("q"),
    )
    valued = shares.where(F.col("p") > F.col("q")).select("lang", "source", "part", "item", value(F.col("p"), F.col("q")).alias("value"))
    ranked = valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= top)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {
    "op13_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS place,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ),
        words AS (SELECT lang, source, place, unnest(terms) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT place) >= 10),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        kinds AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
        shares AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v) AS p,
                   1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS whole
            FROM sources s JOIN kept k ON k.lang = s.lang JOIN kinds d ON d.lang = s.lang
            LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source
            LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                   coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))
                             FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term
                             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
            FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        ),
        marked AS (
            SELECT lang, source, 'term' AS part, term AS item, (((p - whole) * (p - whole)) // (p + whole))::BIGINT AS value
            FROM shares WHERE n > 0 AND p > whole
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked)
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """
}
