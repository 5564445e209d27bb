"""Dense and keyword scores, fusion of ranked lists, reranking, and the confidence gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import clamp01, fixed, keyword_score
from tessera.functions.text import anchors, matches_anchor, normalize_search, term_set, terms, unnest
from tessera.operators.index import FEW_ROWS, askers_of, few_rows, keep_best, matched_blocks, query_terms, terms_of, top_k, wanted_counts

RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.65, 0.35
MIN_SCORE, MIN_COVERAGE, FALLBACK = 0.32, 0.51, 0.8
RERANK_WEIGHT = 0.6
# Shares of the signals of a heuristic rerank.
RERANK_SHARES = {"overlap": 0.45, "phrase": 0.25, "field": 0.2, "original": 0.1}


def in_blocks(entries: DataFrame, queries: DataFrame, entry_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """Both sides dealt into blocks of bounded size; each block of entries meets each block of
    queries in a group (i, j). Columns are those of both sides, is_query tells them apart."""
    parts = max(1, -(-entries.count() // entry_rows)), max(1, -(-queries.count() // query_rows))
    turn = lambda side, n: F.pmod(F.xxhash64(*side.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.withColumns({"i": turn(entries, parts[0]), "is_query": F.lit(False)}).withColumn("j", every(parts[1]))
    right = queries.withColumns({"j": turn(queries, parts[1]), "is_query": F.lit(True)}).withColumn("i", every(parts[0]))
    return left.unionByName(right, allowMissingColumns=True)


def best_of_block(scores: np.ndarray, k: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, entry) whose score is among the k greatest of its query (and group), ties kept."""
    found = []
    for own in [np.arange(scores.shape[1])] if group is None else [np.flatnonzero(group == g) for g in np.unique(group)]:
        part = scores[:, own]
        if len(own) > k:
            bar = np.partition(part, len(own) - k, axis=1)[:, len(own) - k : len(own) - k + 1]
            q, e = np.nonzero((part >= bar) & (part > -np.inf))
        else:
            q, e = np.nonzero(part > -np.inf)
        found.append((q, own[e]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """rounded() of numbers of 0 or more."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest other vectors of each query (and each `by`).

    vectors: vec_id, embedding. queries: query_id, embedding. Blocks are compared by one matrix
    product each, and only their best go on.
    """
    extra = [by] if by else []
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in extra)

    def compare(block: pa.Table) -> pa.Table:
        is_query = np.asarray(block["is_query"])
        entries, asked = block.filter(pa.array(~is_query)), block.filter(pa.array(is_query))
        if not len(entries) or not len(asked):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), *((c, block.schema.field(c).type) for c in extra), ("score", pa.float64()))})
        held, wanted = (units(np.array(side["embedding"].to_pylist(), float)) for side in (entries, asked))
        scores = rounded(wanted @ held.T, 4)
        ids, query_ids = np.asarray(entries["vec_id"]), np.asarray(asked["query_id"])
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        q, e = best_of_block(scores, k, np.asarray(entries[by]) if by else None)
        return pa.table({"query_id": query_ids[q], "vec_id": ids[e], **{c: entries[c].take(pa.array(e)) for c in extra}, "score": scores[q, e]})

    met = in_blocks(vectors.select("vec_id", "embedding", *extra), queries.select("query_id", "embedding"))
    found = met.groupBy("i", "j").applyInArrow(compare, "query_id long, vec_id long, " + (kinds + ", " if kinds else "") + "score double")
    return top_k(found, k, by=("query_id", *extra), ties=("vec_id",))


def hash_embed(term_lists: list[list[str]] | pa.ListArray, size: int = 64) -> np.ndarray:
    """Rows of functions.scores.hash_embedding, for all terms at once. Lists of an Arrow array have distinct terms."""
    lists = term_lists if isinstance(term_lists, pa.ListArray) else pa.array([list(dict.fromkeys(ts)) for ts in term_lists], pa.list_(pa.string()))
    flat = lists.flatten()
    points = np.frombuffer("".join(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), "").to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.asarray(pc.utf8_length(flat)).astype(np.int64)
    ends = np.cumsum(lengths)
    powers = np.array([pow(31, n, size) for n in range(int(lengths.max(initial=0)) + 1)])
    sums = np.concatenate([[0], np.cumsum(points * powers[np.repeat(ends, lengths) - np.arange(len(points)) - 1] % size)])
    buckets = (sums[ends] - sums[ends - lengths]) % size
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
    return np.bincount(row * size + buckets, minlength=len(lists) * size).reshape(len(lists), size).astype(float)


def dense_top_k(entries: DataFrame, queries: DataFrame, k: int, embed=hash_embed, keys: tuple[str, ...] = ("doc_id", "chunk_index"), text_col: str = "chunk_text") -> DataFrame:
    """query_id, keys, vector, keyword, score, rank: embeddings of the texts' terms by `embed`, mixed
    with keyword scores. Integer keys.

    Blocks of entries are scored where they are read, each by one matrix product, and a task hands on its best k
    of each query: entries are never shuffled. Queries with more than FEW_ROWS terms in all are dealt into
    blocks with the entries. entries may be with_terms().
    """
    held = entries.select(*[F.col(c).cast("long").alias(c) for c in keys], F.array_distinct(terms_of(entries, text_col)).alias("terms"))
    asked = queries.select("query_id", term_set(F.col("query")).alias("terms"))
    ties = (F.desc("vector"), F.desc("keyword"), *keys)
    kinds = "query_id long, " + ", ".join(f"{c} long" for c in keys) + ", vector double, keyword double, score double"
    pairs = query_terms(queries).where("query_id IS NOT NULL").limit(FEW_ROWS + 1).toArrow().combine_chunks()
    if len(pairs) > FEW_ROWS:
        return top_k(dense_blocks(held, asked, k, embed, keys, kinds), k, ties=ties)
    ids, wanted = pairs["query_id"].unique(), pairs["term"].unique()
    askers, first, sizes = askers_of(pairs, ids, wanted)
    order = [(c, "descending") for c in ("score", "vector", "keyword")] + [(c, "ascending") for c in keys]
    query = np.asarray(pc.index_in(pairs["query_id"], value_set=ids))
    by_query = np.argsort(query, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs["term"].take(pa.array(by_query)).combine_chunks())
    vectors_of = lambda lists: units(embed(lists if embed is hash_embed else lists.to_pylist()))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        best_yet, bars, asks = None, np.full(len(ids), -np.inf), vectors_of(lists)
        for batch in batches:
            if not len(batch):
                continue
            has, places = vectors_of(batch.column("terms")), wanted_counts(batch, wanted).column("places")
            for begin, width, _, _, cell in matched_blocks(places, askers, first, len(ids)):
                found = np.bincount(cell, minlength=len(ids) * width).reshape(len(ids), width)
                q, e, vector, keyword = near_best(asks @ has[begin : begin + width].T, found / sizes[:, None], bars, k)
                score = half_up(np.maximum(np.maximum(vector, keyword), 0.82 * vector + 0.18 * keyword), 6)
                sure = np.flatnonzero((vector > 0) & (score >= bars[q]))
                if len(sure):
                    own, at = batch.slice(begin, width), pa.array(e[sure])
                    rows = {"q": pa.array(q[sure]), **{c: own.column(c).take(at) for c in keys}, "vector": vector[sure], "keyword": keyword[sure], "score": score[sure]}
                    best_yet = keep_best(best_yet, pa.table(rows), k, order, bars)
        if best_yet is not None:
            named = best_yet.set_column(0, "query_id", ids.take(best_yet["q"].combine_chunks()).cast(pa.int64()))
            yield from named.to_batches(max_chunksize=10_000)

    return top_k(held.mapInArrow(best, kinds), k, ties=ties)


def near_best(vector: np.ndarray, keyword: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions (query, entry) that may be among the k best of a block and reach the query's bar, with vector
    (four decimals) and keyword (six): the score is the greater of both, and rounding moves it by half of 1e-4 at most,
    so that what lies 1e-4 below the k-th can't be among them."""
    rough, floor = np.maximum(vector, keyword), bars - 2e-4
    none = np.flatnonzero(bars == -np.inf)
    if len(none) and rough.shape[1] > k:
        at = rough.shape[1] - k
        floor[none] = np.partition(np.where(vector[none] > 4e-5, rough[none], -np.inf), at, axis=1)[:, at] - 2e-4
    q, e = np.nonzero((rough >= floor[:, None]) & (vector > 4e-5))
    return q, e, half_up(vector[q, e], 4), half_up(keyword[q, e], 6)


def dense_blocks(held: DataFrame, asked: DataFrame, k: int, embed, keys: tuple[str, ...], kinds: str) -> DataFrame:
    """The rows of dense_top_k() with the best k of each block of entries (keys, terms) and queries (query_id, terms)."""

    def compare(block: pa.Table) -> pa.Table:
        is_query = np.asarray(block["is_query"])
        held, asked = block.filter(pa.array(~is_query)), block.filter(pa.array(is_query))
        terms, wanted = held["terms"].to_pylist(), asked["terms"].to_pylist()
        columns = ["query_id", *keys, "vector", "keyword", "score"]
        if not terms or not wanted:
            return pa.table({c: pa.array([], pa.float64() if c in columns[-3:] else pa.int64()) for c in columns})
        vector = np.maximum(0, rounded(units(embed(wanted)) @ units(embed(terms)).T, 4))
        column = {t: n for n, t in enumerate(sorted({t for ts in wanted for t in ts}))}
        has = np.zeros((len(terms), max(1, len(column))), np.float32)
        for row, ts in enumerate(terms):
            has[row, [column[t] for t in ts if t in column]] = 1
        needs = np.zeros((len(wanted), has.shape[1]), np.float32)
        for row, ts in enumerate(wanted):
            needs[row, [column[t] for t in ts]] = 1
        count = np.maximum(1, needs.sum(1, keepdims=True, dtype=float))
        keyword = rounded((needs @ has.T).astype(float) / count, 6)
        score = rounded(np.maximum(np.maximum(vector, keyword), 0.82 * vector + 0.18 * keyword), 6)
        q, e = best_of_block(np.where(vector > 0, score, -np.inf), k)
        ids = {c: np.asarray(held[c]).astype(np.int64)[e] for c in keys}
        return pa.table({"query_id": np.asarray(asked["query_id"])[q], **ids, "vector": vector[q, e], "keyword": keyword[q, e], "score": score[q, e]})

    return in_blocks(held, asked, entry_rows=4096, query_rows=256).groupBy("i", "j").applyInArrow(compare, kinds)


def keyword_scores(entries: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """query_id, keys, keyword (share of the query's terms that occur), for entries with at least one.

    An inverted index: entries are matched by term, never query by query.
    """
    asked = query_terms(queries)
    small = few_rows(asked)
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    held = unnest(entries, list(keys), term_set(F.col(text_col)), "term")
    hits = held.join(small(asked), "term").groupBy("query_id", *keys).agg(F.count(F.lit(1)).alias("found"))
    return hits.join(small(sizes), "query_id").select("query_id", *keys, fixed(F.col("found") / F.col("wanted"), 6).alias("keyword"))


def keyword_of(side: DataFrame) -> Column:
    return F.col("keyword") if "keyword" in side.columns else F.lit(None).cast("double")


def weighted_fusion(dense: DataFrame, sparse: DataFrame, keys: tuple[str, ...], dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """query_id, keys, dense, sparse, keyword, score: each side by its own maximum, then the weighted sum.

    Both inputs have query_id, keys, score and, if known, keyword; a side without the entry counts 0. Weights are
    scaled to sum 1 (halves if they sum to 0 or less).
    """
    total = dense_weight + sparse_weight
    a, b = (dense_weight / total, sparse_weight / total) if total > 0 else (0.5, 0.5)

    def scaled(side: DataFrame, name: str) -> DataFrame:
        most = F.max("score").over(Window.partitionBy("query_id"))
        return side.select("query_id", *keys, F.when(most > 0, F.col("score") / most).otherwise(0.0).alias(name), keyword_of(side).alias(f"{name}_keyword"))

    both = scaled(dense, "dense").join(scaled(sparse, "sparse"), ["query_id", *keys], "full_outer")
    both = both.select("query_id", *keys, F.coalesce("dense", F.lit(0.0)).alias("dense"), F.coalesce("sparse", F.lit(0.0)).alias("sparse"), F.coalesce("dense_keyword", "sparse_keyword").alias("keyword"))
    return both.select("query_id", *keys, fixed(F.col("dense"), 6).alias("dense"), fixed(F.col("sparse"), 6).alias("sparse"), "keyword", fixed(F.col("dense") * a + F.col("sparse") * b, 6).alias("score"))


#: The order of fused results: what parts equal scores, the entry's keys after it.
WEIGHTED_TIES = ("sparse", "dense", "keyword")
RRF_TIES = ("sparse_rank", "dense_rank")


def fused_top_k(fused: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """The best k of weighted_fusion() or rrf_fusion() with their rank: by score, then by the parts
    (greatest score, least rank, none last), then by the keys."""
    parts = [F.asc_nulls_last(c) for c in RRF_TIES] if "sparse_rank" in fused.columns else [F.desc(c) for c in WEIGHTED_TIES]
    return top_k(fused, k, ties=(*parts, *keys))


def rrf_fusion(dense: DataFrame, sparse: DataFrame, keys: tuple[str, ...], k: int = RRF_K, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """query_id, keys, ranks, keyword, score: sum of weight / (k + rank) over the sides (both have
    query_id, keys, rank and, if known, keyword)."""
    total = dense_weight + sparse_weight
    a, b = (dense_weight / total, sparse_weight / total) if total > 0 else (0.5, 0.5)
    left = dense.select("query_id", *keys, F.col("rank").alias("dense_rank"), keyword_of(dense).alias("dense_keyword"))
    right = sparse.select("query_id", *keys, F.col("rank").alias("sparse_rank"), keyword_of(sparse).alias("sparse_keyword"))
    both = left.join(right, ["query_id", *keys], "full_outer")
    share = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return both.select("query_id", *keys, "dense_rank", "sparse_rank", F.coalesce("dense_keyword", "sparse_keyword").alias("keyword"), fixed(share(a, "dense_rank") + share(b, "sparse_rank"), 8).alias("score"))


def query_signals(queries: DataFrame) -> DataFrame:
    """query_id, wanted (terms), asked_anchors, phrases: what a rerank looks for."""
    wanted = term_set(F.col("query"))
    asked = anchors(F.col("query"))
    phrase = F.array_join(terms(F.col("query")), " ")  # in full, as the query says it: with repeats
    normal = normalize_search(F.col("query"))
    longer = lambda p: F.when(p.contains(" "), F.array(p)).otherwise(F.array().cast("array<string>"))
    phrases = F.array_distinct(F.concat(F.transform(asked, lambda x: x["phrase"]), longer(phrase), longer(normal)))
    return queries.select("query_id", wanted.alias("wanted"), asked.alias("asked_anchors"), phrases.alias("phrases"))


def heuristic_rerank(results: DataFrame, queries: DataFrame, k: int, weight: float = RERANK_WEIGHT, keys: tuple[str, ...] = ("doc_id", "chunk_index"), text_col: str = "chunk_text", field_col: str | None = None) -> DataFrame:
    """query_id, keys, original, rerank, score, rank.

    results: query_id, keys, score and the text (with file name and heading in field_col). Raw
    score: shares of term overlap, phrase or anchor hit, field hit and the original score by its
    maximum; the rerank score is the raw one by its maximum, mixed with the original by weight.
    """
    text = F.col(text_col)
    field = F.col(field_col) if field_col else F.lit("")
    joined = results.select("query_id", *keys, F.col("score").alias("original"), term_set(text).alias("held"), normalize_search(text).alias("body"), term_set(field).alias("held_field"), normalize_search(field).alias("field"))
    joined = joined.join(query_signals(queries), "query_id")
    hit = lambda body: F.exists("phrases", lambda p: F.col(body).contains(p))
    covered = F.size(F.filter("asked_anchors", lambda a: matches_anchor(a, F.col("body"), F.col("held"))))
    phrase = F.when(hit("body"), 1.0).when(F.size("asked_anchors") > 0, covered / F.size("asked_anchors")).otherwise(0.0)
    overlap = lambda held: F.coalesce(keyword_score(F.col("wanted"), F.col(held)), F.lit(0.0))
    in_field = F.when(F.col("field") == "", 0.0).otherwise(F.greatest(F.when(hit("field"), 1.0).otherwise(0.0), overlap("held_field")))
    per_query = Window.partitionBy("query_id")
    most = F.max("original").over(per_query)
    share = F.when(most > 0, clamp01(F.col("original") / most)).otherwise(0.0)
    raw = clamp01(overlap("held") * RERANK_SHARES["overlap"] + phrase * RERANK_SHARES["phrase"] + in_field * RERANK_SHARES["field"] + share * RERANK_SHARES["original"])
    scored = joined.select("query_id", *keys, "original", raw.alias("raw"))
    most_raw = F.max("raw").over(per_query)
    again = F.when(most_raw > 0, clamp01(F.col("raw") / most_raw)).otherwise(0.0)
    scored = scored.select("query_id", *keys, "original", fixed(again, 6).alias("rerank"))
    scored = scored.withColumn("score", fixed(F.col("original") * (1 - weight) + F.col("rerank") * weight, 6))
    order = per_query.orderBy(F.desc("score"), F.desc("rerank"), F.desc("original"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def minmax_rerank(results: DataFrame, model_score: Column, k: int, weight: float = RERANK_WEIGHT, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """query_id, keys, original, rerank, score, rank: a pair model's scores between 0 and 1 within a
    query (as they are, clamped, where all are equal), mixed with the original score."""
    per_query = Window.partitionBy("query_id")
    rows = results.select("query_id", *keys, F.col("score").alias("original"), model_score.alias("model"))
    low, high = F.min("model").over(per_query), F.max("model").over(per_query)
    rows = rows.withColumn("rerank", fixed(F.when(high > low, clamp01((F.col("model") - low) / (high - low))).otherwise(clamp01(F.col("model"))), 6))
    rows = rows.withColumn("score", fixed(F.col("original") * (1 - weight) + F.col("rerank") * weight, 6)).drop("model")
    order = per_query.orderBy(F.desc("score"), F.desc("rerank"), F.desc("original"), *keys)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_queries(results: DataFrame, keys: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """Results of several sub-queries (question_id, sub_query, position, keys, score, keyword) as one
    list per question: the best of 2 keyword + score for each entry, placed where it was first seen."""
    best = F.struct((F.coalesce("keyword", F.lit(0.0)) * 2 + F.col("score")).alias("strength"), (-F.col("sub_query")).alias("earlier"))
    merged = results.groupBy("question_id", *keys).agg(
        F.max_by(F.struct("score", "keyword", "sub_query"), best).alias("best"), F.min(F.struct("sub_query", "position")).alias("seen")
    )
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("seen", *keys))
    return merged.select("question_id", *keys, "best.score", "best.keyword", F.col("best.sub_query").alias("from_query"), place.alias("place"))


def qualified(results: DataFrame, least: float) -> DataFrame:
    """Results of at least this score whose keyword score is null or covers enough of the query."""
    return results.where((F.col("score") >= least) & (F.col("keyword").isNull() | (F.col("keyword") >= MIN_COVERAGE)))


def confidence(results: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("query_id",), least: float = MIN_SCORE, text_col: str = "chunk_text") -> DataFrame:
    """Per query (and further columns of `by`): confident, usable (results), missing (anchors), failure.

    results: query_id, keys, score, keyword, text. A first pass at the least score must cover all
    anchors of the query; else a second at FALLBACK times it; failure tells what is wanting.
    """
    asked = queries.select("query_id", anchors(F.col("query")).alias("asked"))
    rows = results.join(asked, "query_id").withColumns({"held": term_set(F.col(text_col)), "body": normalize_search(F.col(text_col))})
    rows = rows.withColumn("matched", F.filter("asked", lambda a: matches_anchor(a, F.col("body"), F.col("held"))))
    passes = (F.size("asked") == 0) | (F.size("matched") > 0)
    enough = F.col("keyword").isNull() | (F.col("keyword") >= MIN_COVERAGE)

    def sums(bar: float, name: str) -> list[Column]:
        good = (F.col("score") >= bar) & enough
        return [F.count_if(good & passes).alias(f"{name}_usable"), F.array_distinct(F.flatten(F.collect_list(F.when(good, F.transform("matched", lambda a: a["phrase"]))))).alias(f"{name}_seen"), F.count_if(good).alias(f"{name}_any")]

    found = rows.groupBy(*by).agg(*sums(least, "strong"), *sums(least * FALLBACK, "weak"))
    base = (results.select(*by).distinct().join(asked, "query_id") if len(by) > 1 else asked).join(found, list(by), "left")
    phrases = F.transform("asked", lambda a: a["phrase"])
    none = F.array().cast("array<string>")
    left = lambda name: F.size(F.array_except(phrases, F.coalesce(f"{name}_seen", none)))
    count = lambda name: F.coalesce(f"{name}_usable", F.lit(0))
    strong = (count("strong") > 0) & (left("strong") == 0)
    weak = (count("weak") > 0) & (left("weak") == 0)
    failure = F.when(strong | weak, None).when((F.size("asked") > 0) & (F.coalesce("weak_any", F.lit(0)) > 0), "missing_anchor_coverage").otherwise("low_relevance")
    return base.select(
        *by,
        (strong | weak).alias("confident"),
        F.when(strong, count("strong")).when(weak, count("weak")).otherwise(0).cast("long").alias("usable"),
        F.when(strong, 0).otherwise(left("weak")).cast("long").alias("missing"),
        failure.alias("failure"),
    )


def comparison_confidence(per_document: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, documents, covered, confident: usable results in two of the selected documents (all, if fewer).

    per_document: query_id, doc_id, usable. selected: query_id, doc_id.
    """
    rows = selected.join(per_document, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("usable", F.lit(0)) > 0).alias("covered"))
    return rows.select("query_id", "documents", "covered", ((F.col("covered") > 0) & (F.col("covered") >= F.least(F.lit(2), F.col("documents")))).alias("confident"))


# What asks for a comparison, with its weight.
COMPARISON_SIGNALS = [
    (0.9, r"(?i)\b(compare|comparison|difference|differences|different|versus|vs|same|similar|conflict|conflicts|contradict|contradiction|contrast)\b|区别|差异|不同|对比|比较|冲突|一致|相同"),
    (0.7, r"(?i)\b(which|what)\s+(document|file|policy|manual|handbook)\b|\b(document|file)\s+(says|states|mentions|contains)\b|哪个文档|哪份文档|哪份文件|哪个文件"),
    (
        0.72,
        r"(?i)\b(which|what|who)\b[^?]*(more|less|higher|lower|greater|fewer|most|least|longer|shorter|earlier|later|stricter|looser|allows?|requires?)\b|\b(more|less|higher|lower|greater|fewer|longer|shorter|earlier|later|stricter|looser)\b[^?]*\bthan\b|哪(?:个|份|些)?[^？?]*(更多|更少|更高|更低|更长|更短|更严格|更宽松)|谁[^？?]*更",
    ),
    (0.62, r"(?i)\b(across|between|among)\b[^?]*(documents|files|policies|manuals|handbooks)|\b(do|does|are|is)\b[^?]*(align|match|agree|consistent)\b|是否一致|有没有.*(?:差异|冲突)|之间.*(?:关系|一致|冲突|差异)"),
]


def route(query: Column, documents: Column) -> tuple[Column, Column]:
    """Mode (compare or qa) and confidence of a question over so many documents."""
    total = sum((F.when(query.rlike(pattern), weight).otherwise(0.0) for weight, pattern in COMPARISON_SIGNALS), F.lit(0.0))
    sure = clamp01(F.coalesce(total, F.lit(0.0)))
    return F.when((documents > 1) & (sure >= 0.5), "compare").otherwise("qa"), sure
