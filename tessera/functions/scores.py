"""Similarities, weights and rounding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BM25_K1, BM25_B = 1.2, 0.75


def fixed(value: Column, digits: int = 4) -> Column:
    """Non-negative values rounded half up at so many digits."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded share; null where the whole is zero."""
    return fixed(part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """Dot product over the shared length by the norms of the whole vectors; 0 for zero vectors."""
    size = norm(left) * norm(right)
    return F.when(size > 0, dot(left, right) / size).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays of distinct values; 1 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def overlap(left: Column, right: Column) -> Column:
    """Shared values by the size of the smaller set; 0 if one is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def keyword_score(query_terms: Column, found_terms: Column) -> Column:
    """Share of the distinct query terms that occur; null for a query without terms."""
    return F.when(F.size(query_terms) > 0, F.size(F.array_intersect(query_terms, found_terms)) / F.size(query_terms))


def combined_score(vector: Column, keyword: Column, vector_weight: float = 0.82, keyword_weight: float = 0.18) -> Column:
    """The greatest of both scores and their mix; the vector score where there is no keyword score."""
    return F.when(keyword.isNull(), vector).otherwise(F.greatest(vector, keyword, vector * vector_weight + keyword * keyword_weight))


def bm25_idf(documents: Column, with_term: Column) -> Column:
    return F.log(F.lit(1.0) + (documents - with_term + 0.5) / (with_term + 0.5))


def bm25_weight(idf: Column, tf: Column, length: Column, mean_length: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """Columns or numpy arrays."""
    return idf * (tf * (k1 + 1)) / (tf + k1 * ((1 - b) + b * length / mean_length))


def hash_embedding(terms: Column, size: int = 64) -> Column:
    """Counts of distinct terms by the bucket of a rolling hash of their code points."""
    bucket = lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h * 31 + F.ascii(c)) % size))
    buckets = F.transform(F.array_distinct(terms), bucket)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))


def token_estimate(characters: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for 0, null for null."""
    return F.when(characters == 0, 0).when(characters > 0, F.greatest(F.lit(1), F.ceil(characters / 4)))


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Per-million rates; null unless all four are known."""
    return tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out
