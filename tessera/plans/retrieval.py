"""Ranked retrieval over chunks, its metrics, and comparisons of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.functions.scores import fixed, jaccard, keyword_score
from tessera.functions.text import normalize_search, searchable, term_set
from tessera.operators import comparison, index, metrics, retrieval
from tessera.operators.chunking import fixed_windows
from tessera.plans.tables import HOLDERS_SQL, chunks, documents, holders, questions, table
from tessera.sources.scratch import kept

TOP_K, CANDIDATES = 6, 18
KEYS = ("doc_id", "chunk_index")


def sparse_candidates(spark: SparkSession, sf_dir: str, k: int = CANDIDATES, read: DataFrame | index.Counted | None = None) -> DataFrame:
    """The best k chunks of each question: k rows a question, kept as several steps read them.
    read: written_terms() of the chunks, or read_once() for the questions, where the caller has them."""
    return kept(index.bm25_top_k(chunks(spark, sf_dir) if read is None else read, questions(spark, sf_dir), k))


def dense_candidates(spark: SparkSession, sf_dir: str, k: int = CANDIDATES, read: DataFrame | None = None) -> DataFrame:
    return retrieval.dense_top_k(chunks(spark, sf_dir) if read is None else read, questions(spark, sf_dir), k)


def both_sides(spark: SparkSession, sf_dir: str, dense_k: int = CANDIDATES, sparse_k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse candidates; texts are cut and read into terms once for both."""
    read = index.written_terms(chunks(spark, sf_dir), KEYS)
    return dense_candidates(spark, sf_dir, dense_k, read), sparse_candidates(spark, sf_dir, sparse_k, read)


def longs(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("long") for n in names})


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(sparse_candidates(spark, sf_dir, TOP_K), "chunk_index", "rank").select("query_id", "doc_id", "chunk_index", "score", "keyword", "rank")


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 20 against all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return longs(retrieval.cosine_top_k(vectors, asked, TOP_K), "rank")


def per_label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest vectors of every label, for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return longs(retrieval.cosine_top_k(vectors, asked, 2, by="label"), "rank")


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.keyword_scores(documents(spark, sf_dir), questions(spark, sf_dir))
    return longs(index.top_k(scored, TOP_K, ties=("doc_id",), score="keyword"), "rank")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(dense_candidates(spark, sf_dir, TOP_K), "chunk_index", "rank")


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.weighted_fusion(*both_sides(spark, sf_dir), KEYS)
    return longs(retrieval.fused_top_k(fused, TOP_K, KEYS), "chunk_index", "rank")


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three results of a fusion without a reranker, from the depths that so few results take."""
    sparse_k, dense_k = index.hybrid_depths(3)
    fused = retrieval.weighted_fusion(*both_sides(spark, sf_dir, dense_k, sparse_k), KEYS)
    return longs(retrieval.fused_top_k(fused, 3, KEYS), "chunk_index", "rank")


def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's vector as a digest, with its length and largest weight."""
    vectors = index.sparse_vectors(chunks(spark, sf_dir))
    listed = F.array_join(F.transform("entries", lambda e: F.concat(e["term"], F.lit("="), F.round(e["weight"] * 1e6).cast("long"))), ",")
    return vectors.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("entries").cast("long").alias("terms"), F.array_max(F.transform("entries", lambda e: e["weight"])).alias("largest"), F.md5(listed).alias("entries_md5"))


def titled_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the searchable text of chunks: the source stands for the file name."""
    named = fixed_windows(documents(spark, sf_dir).where("doc_id IS NOT NULL"), keys=("doc_id", "source"))
    rows = named.select(*KEYS, searchable(F.col("source"), F.lit(None).cast("string"), F.col("chunk_text")).alias("chunk_text"))
    asked = questions(spark, sf_dir).withColumn("query", F.concat_ws(" ", F.concat(F.lit("src"), F.col("query_id") % 20), "query"))
    return longs(index.bm25_top_k(rows, asked, TOP_K), "chunk_index", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.rrf_fusion(*both_sides(spark, sf_dir), KEYS)
    return longs(retrieval.fused_top_k(fused, TOP_K, KEYS), "chunk_index", "rank", "dense_rank", "sparse_rank")


def with_chunk_text(spark: SparkSession, sf_dir: str, results: DataFrame) -> DataFrame:
    """results (kept) with the texts of their chunks; only their documents are cut into chunks."""
    texts = fixed_windows(only(documents(spark, sf_dir), results.select("doc_id").distinct()))
    return results.join(texts, list(KEYS))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of these ids: read through a broadcast of the ids, if they are few."""
    return docs.join(index.few_rows(ids)(ids), "doc_id", "left_semi")


def reranked(spark: SparkSession, sf_dir: str, k: int = TOP_K, candidates: DataFrame | None = None) -> DataFrame:
    """candidates: sparse_candidates(), where the caller needs them too."""
    results = with_chunk_text(spark, sf_dir, candidates or sparse_candidates(spark, sf_dir))
    return kept(retrieval.heuristic_rerank(results, questions(spark, sf_dir), k))


def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(reranked(spark, sf_dir), "chunk_index", "rank")


def minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair model is the term Jaccard of query and chunk."""
    results = with_chunk_text(spark, sf_dir, sparse_candidates(spark, sf_dir)).join(questions(spark, sf_dir), "query_id")
    model = jaccard(term_set(F.col("query")), term_set(F.col("chunk_text")))
    return longs(retrieval.minmax_rerank(results, model, TOP_K), "chunk_index", "rank")


def evidence(spark: SparkSession, sf_dir: str, candidates: DataFrame | None = None) -> DataFrame:
    """Reranked results with their keyword score and text."""
    results = with_chunk_text(spark, sf_dir, reranked(spark, sf_dir, candidates=candidates)).join(questions(spark, sf_dir), "query_id")
    return results.withColumn("keyword", fixed(keyword_score(term_set(F.col("query")), term_set(F.col("chunk_text"))), 6)).drop("query")


def qa_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.confidence(evidence(spark, sf_dir), questions(spark, sf_dir))


def compare_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents of each query's candidates are covered by usable results."""
    candidates = sparse_candidates(spark, sf_dir)
    found = evidence(spark, sf_dir, candidates)
    usable = retrieval.confidence(found, questions(spark, sf_dir), by=("query_id", "doc_id")).select("query_id", "doc_id", "usable")
    return retrieval.comparison_confidence(usable, candidates.select("query_id", "doc_id").distinct())


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage asked whole and by its halves; the lists as one."""
    asked = questions(spark, sf_dir)
    half = F.floor(F.length("query") / 2).cast("int")
    parts = asked.select("query_id", F.posexplode(F.array(F.col("query"), F.substring("query", F.lit(1), half), F.substring("query", half + 1, F.length("query")))).alias("sub_query", "part"))
    parts = parts.select((F.col("query_id") * 10 + F.col("sub_query")).alias("query_id"), F.col("part").alias("query"))
    docs = documents(spark, sf_dir)
    ranked = index.top_k(retrieval.keyword_scores(docs, parts), TOP_K, ties=("doc_id",), score="keyword")
    rows = ranked.select(F.expr("query_id DIV 10").alias("question_id"), (F.col("query_id") % 10).alias("sub_query"), F.col("rank").alias("position"), "doc_id", F.col("keyword").alias("score"), "keyword")
    return longs(retrieval.merge_queries(rows, ("doc_id",)), "place")


def query_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions over as many documents as the turn's number."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    mode, sure = retrieval.route(F.col("text"), F.col("turn") + 1)
    return turns.select("conv_id", "turn", mode.alias("mode"), fixed(sure).alias("confidence"))


def by_document(ranking: DataFrame) -> DataFrame:
    """One place per document, that of its best chunk."""
    best = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best"))).drop("best")


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(by_document(sparse_candidates(spark, sf_dir)), kept(holders(spark, sf_dir)), TOP_K)


def rank_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, candidates = kept(holders(spark, sf_dir)), sparse_candidates(spark, sf_dir)
    before = metrics.ranking_metrics(by_document(candidates), expected, 3)
    after = metrics.ranking_metrics(by_document(reranked(spark, sf_dir, CANDIDATES, candidates)), expected, 3)
    return metrics.rank_lift(before, after)


def noise_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = sparse_candidates(spark, sf_dir)
    return metrics.noise_filtering(candidates, reranked(spark, sf_dir, candidates=candidates), kept(holders(spark, sf_dir)))


def sweep_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 at three depths, scored over the passages that some document holds."""
    ranking, expected = by_document(sparse_candidates(spark, sf_dir)), kept(holders(spark, sf_dir))
    asked = expected.select("query_id").distinct()
    rows = None
    for k in (1, 3, 6):
        one = metrics.ranking_metrics(ranking, expected, k).join(asked, "query_id", "left_semi").withColumn("variant", F.lit(f"top{k}"))
        rows = one if rows is None else rows.unionByName(one)
    return metrics.sweep_score(rows)


def selected(spark: SparkSession, sf_dir: str, candidates: DataFrame | None = None) -> DataFrame:
    """For each query the documents of its best six chunks (candidates, where the caller needs them too),
    with their whole texts as evidence."""
    chosen = (candidates or sparse_candidates(spark, sf_dir, TOP_K)).select(F.col("query_id").alias("group_id"), "doc_id").distinct()
    return chosen.join(only(documents(spark, sf_dir).select("doc_id", "text"), chosen.select("doc_id").distinct()), "doc_id")


def pair_analysis(spark: SparkSession, sf_dir: str, candidates: DataFrame | None = None) -> DataFrame:
    return comparison.analyse_pairs(kept(comparison.evidence_features(selected(spark, sf_dir, candidates))))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_analysis(spark, sf_dir).select("group_id", "left_doc", "right_doc", "term_jaccard", "sentence_overlap", "near_duplicate", "strong_near_duplicate", "only_left", "only_right")


def _verdicts(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    found = candidates.groupBy(F.col("query_id").alias("group_id"), "doc_id").agg(F.count(F.lit(1)).alias("results"))
    return comparison.verdicts(pairs, found)


def comparison_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = sparse_candidates(spark, sf_dir, TOP_K)
    return _verdicts(candidates, pair_analysis(spark, sf_dir, candidates))


def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage but gave none of its best six chunks."""
    found = sparse_candidates(spark, sf_dir, TOP_K).select("query_id", "doc_id")
    return holders(spark, sf_dir).join(found, ["query_id", "doc_id"], "left_anti")


def missing_from_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage but did not give its single best chunk."""
    found = sparse_candidates(spark, sf_dir, 1).select("query_id", "doc_id")
    return holders(spark, sf_dir).join(found, ["query_id", "doc_id"], "left_anti")


def pair_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.diagnostics(pair_analysis(spark, sf_dir))


def comparison_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = sparse_candidates(spark, sf_dir, TOP_K)
    pairs = kept(pair_analysis(spark, sf_dir, candidates))
    return comparison.comparison_answers(_verdicts(candidates, pairs), pairs)


def entailed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a query's best three chunks entail each other."""
    rows = with_chunk_text(spark, sf_dir, sparse_candidates(spark, sf_dir, 3)).select(F.col("query_id").alias("group_id"), F.concat_ws(":", "doc_id", "chunk_index").alias("doc_id"), F.col("chunk_text").alias("text"))
    return comparison.entailment(rows)


def source_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_chunk_text(spark, sf_dir, sparse_candidates(spark, sf_dir)).select(F.col("query_id").alias("group_id"), *KEYS, "score", F.col("chunk_text").alias("text"))
    return comparison.source_bundle(rows, documents=4)


QUERIES = {
    "bm25_topk": bm25_topk,
    "cosine_topk": cosine_topk,
    "per_label_topk": per_label_topk,
    "keyword_topk": keyword_topk,
    "dense_topk": dense_topk,
    "weighted_fusion": weighted_fusion,
    "rrf_fusion": rrf_fusion,
    "hybrid_topk": hybrid_topk,
    "sparse_vectors": sparse_vectors,
    "titled_bm25": titled_bm25,
    "heuristic_rerank": heuristic_rerank,
    "minmax_rerank": minmax_rerank,
    "qa_confidence": qa_confidence,
    "compare_confidence": compare_confidence,
    "multi_query_merge": multi_query_merge,
    "query_router": query_router,
    "ranking_metrics": ranking_metrics,
    "rank_lift": rank_lift,
    "noise_filtering": noise_filtering,
    "sweep_score": sweep_score,
    "near_duplicate_pairs": near_duplicate_pairs,
    "pair_analysis": pair_analysis,
    "comparison_verdicts": comparison_verdicts,
    "missing_documents": missing_documents,
    "missing_from_best": missing_from_best,
    "source_bundle": source_bundle,
    "pair_diagnostics": pair_diagnostics,
    "comparison_answers": comparison_answers,
    "entailed_evidence": entailed_evidence,
}

#: Common tables of the oracles.
_CHUNKS = f"c AS MATERIALIZED (SELECT doc_id, chunk_index, chunk_text, {sql.terms('chunk_text')} AS terms FROM ({sql.chunks()}))"
_ASKED = f"q AS MATERIALIZED (SELECT item_id AS query_id, text AS query, {sql.term_set('text')} AS wanted FROM benchmark), qt AS MATERIALIZED (SELECT query_id, unnest(wanted) AS term FROM q)"
_BM25 = f"""
    stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM c),
    tf AS MATERIALIZED (SELECT doc_id, chunk_index, length, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, len(terms) AS length, unnest(terms) AS term FROM c) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (
        SELECT query_id, doc_id, chunk_index,
               {sql.fixed("sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))", 6)} AS score,
               {sql.fixed("count(*) / any_value(k)", 6)} AS keyword
        FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN (SELECT query_id, len(wanted) AS k FROM q) USING (query_id) CROSS JOIN stats GROUP BY query_id, doc_id, chunk_index
    ),
    sparse AS MATERIALIZED (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyword DESC, doc_id, chunk_index) AS rank FROM scored) WHERE rank <= {CANDIDATES}
    )
"""
_RANKED = f"WITH {_CHUNKS}, {_ASKED}, {_BM25}"
_HOLDERS = f"held AS MATERIALIZED ({HOLDERS_SQL})"


def _metrics_sql(ranking: str, k: int) -> str:
    """Metrics of a ranking (query_id, doc_id, rank) against held."""
    return f"""
        SELECT query_id,
               CASE WHEN units > 0 THEN {sql.fixed("coalesce(gain, 0) / list_sum(list_transform(range(1, least(units, " + str(k) + ") + 1), lambda i: 3 / log2(i + 1)))")} END AS ndcg,
               CASE WHEN returned > 0 THEN {sql.fixed("hits / returned")} END AS precision,
               CASE WHEN units > 0 THEN {sql.fixed("coalesce(hits, 0) / units")} END AS recall,
               {sql.fixed("coalesce(1.0 / first_hit, 0)")} AS mrr,
               CASE WHEN returned > 0 THEN {sql.fixed("(returned - hits) / returned")} END AS noise
        FROM (
            SELECT query_id, sum(CASE WHEN held.doc_id IS NOT NULL THEN 3 / log2(rank + 1) ELSE 0 END) AS gain, count(*) AS returned,
                   count(held.doc_id) AS hits, min(CASE WHEN held.doc_id IS NOT NULL THEN rank END) AS first_hit
            FROM ({ranking}) r LEFT JOIN held USING (query_id, doc_id) WHERE rank <= {k} GROUP BY query_id
        ) FULL JOIN (SELECT query_id, count(*) AS units FROM held GROUP BY query_id) USING (query_id)
    """


_BY_DOCUMENT = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM sparse GROUP BY query_id, doc_id"
_NEAREST = """
    SELECT q.vec_id AS query_id, v.vec_id, v.label, sign(s) * floor(abs(s) * 1e4 + 0.5) / 1e4 AS score
    FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id,
         LATERAL (SELECT list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s)
"""
_KEYWORD = f"""
    SELECT query_id, doc_id, {sql.fixed("count(*) / wanted", 6)} AS keyword
    FROM (SELECT doc_id, unnest({sql.term_set("text")}) AS term FROM documents) JOIN (SELECT query_id, len(wanted) AS wanted, unnest(wanted) AS term FROM q) USING (term)
    GROUP BY query_id, doc_id, wanted
"""
_PHRASES = f"SELECT query_id, list_filter([array_to_string({sql.terms('query')}, ' '), {sql.normalize_search('query')}], lambda p: contains(p, ' ')) AS phrases FROM q"
_PAIRS = f"""
    picked AS (SELECT DISTINCT query_id AS group_id, doc_id FROM sparse WHERE rank <= {TOP_K}),
    f AS MATERIALIZED (
        SELECT group_id, doc_id, {sql.term_set("text")} AS t, {sql.canonical_sentences("text")} AS s, {sql.numeric_tokens("text")} AS n
        FROM picked JOIN documents USING (doc_id) WHERE {sql.normalize_whitespace("text")} <> ''
    ),
    pairs AS (
        SELECT l.group_id, l.doc_id AS left_doc, r.doc_id AS right_doc,
               CASE WHEN len(l.t) + len(r.t) = 0 THEN 1 ELSE len(list_intersect(l.t, r.t)) / (len(l.t) + len(r.t) - len(list_intersect(l.t, r.t))) END AS j,
               CASE WHEN least(len(l.s), len(r.s)) = 0 THEN 0 ELSE len(list_intersect(l.s, r.s)) / least(len(l.s), len(r.s)) END AS o,
               array_to_string(list_sort(list_filter(l.n, lambda x: NOT list_contains(r.n, x))), '|') AS only_left,
               array_to_string(list_sort(list_filter(r.n, lambda x: NOT list_contains(l.n, x))), '|') AS only_right
        FROM f l JOIN f r ON l.group_id = r.group_id AND l.doc_id < r.doc_id
    )
"""

def _embedding(terms: str) -> str:
    """Counts of distinct terms by the bucket of the rolling hash of their code points."""
    hashed = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(t, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda h, v: (h * 31 + v) % 64)"
    return f"list_transform(range(0, 64), lambda i: CAST(len(list_filter(list_transform({terms}, lambda t: {hashed}), lambda b: b = i)) AS DOUBLE))"


_DENSE = f"""
    cv AS MATERIALIZED (SELECT doc_id, chunk_index, list_distinct(terms) AS held, {_embedding("list_distinct(terms)")} AS v FROM c),
    qv AS MATERIALIZED (SELECT query_id, wanted, {_embedding("wanted")} AS v FROM q),
    near AS (
        SELECT query_id, doc_id, chunk_index, {sql.fixed("coalesce(list_cosine_similarity(cv.v, qv.v), 0)")} AS vector, {sql.fixed("len(list_intersect(wanted, held)) / len(wanted)", 6)} AS keyword
        FROM cv, qv WHERE len(held) > 0
    ),
    mixed AS (SELECT *, {sql.fixed("greatest(vector, keyword, 0.82 * vector + 0.18 * keyword)", 6)} AS score FROM near WHERE vector > 0),
    dense AS MATERIALIZED (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector DESC, keyword DESC, doc_id, chunk_index) AS rank FROM mixed) WHERE rank <= {CANDIDATES}
    )
"""
_RERANKED = f"""
    p AS ({_PHRASES}),
    signal AS (
        SELECT query_id, doc_id, chunk_index, s.score AS original, len(list_intersect(wanted, terms)) / len(wanted) AS overlap,
               len(list_filter(phrases, lambda x: contains(body, x))) > 0 AS hit
        FROM sparse s JOIN (SELECT *, {sql.normalize_search("chunk_text")} AS body FROM c) USING (doc_id, chunk_index) JOIN q USING (query_id) JOIN p USING (query_id)
    ),
    raw AS (SELECT *, least(1, overlap * 0.45 + CAST(hit AS INTEGER) * 0.25 + 0.0 + original / max(original) OVER (PARTITION BY query_id) * 0.1) AS raw FROM signal),
    again AS (SELECT *, {sql.fixed("least(1, raw / max(raw) OVER (PARTITION BY query_id))", 6)} AS rerank FROM raw),
    remixed AS (SELECT query_id, doc_id, chunk_index, original, rerank, {sql.fixed("original * 0.4 + rerank * 0.6", 6)} AS score FROM again),
    reranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rerank DESC, original DESC, doc_id, chunk_index) AS rank FROM remixed)
"""


def _weighted_sql(candidates: int, k: int) -> str:
    return f"""
        {_RANKED}, {_DENSE},
        a AS (SELECT query_id, doc_id, chunk_index, keyword, score / max(score) OVER (PARTITION BY query_id) AS d FROM dense WHERE rank <= {candidates}),
        b AS (SELECT query_id, doc_id, chunk_index, keyword, score / max(score) OVER (PARTITION BY query_id) AS s FROM sparse WHERE rank <= {candidates}),
        f AS (
            SELECT query_id, doc_id, chunk_index, {sql.fixed("coalesce(d, 0)", 6)} AS dense, {sql.fixed("coalesce(s, 0)", 6)} AS sparse, coalesce(a.keyword, b.keyword) AS keyword,
                   {sql.fixed("coalesce(d, 0) * 0.65 + coalesce(s, 0) * 0.35", 6)} AS score
            FROM a FULL JOIN b USING (query_id, doc_id, chunk_index)
        )
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse DESC, dense DESC, keyword DESC, doc_id, chunk_index) AS rank FROM f) WHERE rank <= {k}
    """


_SIGNALS = [(weight, pattern.replace("'", "''")) for weight, pattern in retrieval.COMPARISON_SIGNALS]

ORACLES = {
    "bm25_topk": f"{_RANKED} SELECT query_id, doc_id, chunk_index, score, keyword, rank FROM sparse WHERE rank <= {TOP_K}",
    "cosine_topk": f"SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_NEAREST})) WHERE rank <= {TOP_K}",
    "per_label_topk": f"SELECT query_id, vec_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM ({_NEAREST})) WHERE rank <= 2",
    "keyword_topk": f"WITH {_ASKED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, doc_id) AS rank FROM ({_KEYWORD})) WHERE rank <= {TOP_K}",
    "heuristic_rerank": f"{_RANKED}, {_RERANKED} SELECT * FROM reranked WHERE rank <= {TOP_K}",
    "dense_topk": f"WITH {_CHUNKS}, {_ASKED}, {_DENSE} SELECT query_id, doc_id, chunk_index, vector, keyword, score, rank FROM dense WHERE rank <= {TOP_K}",
    "weighted_fusion": _weighted_sql(CANDIDATES, TOP_K),
    "hybrid_topk": _weighted_sql(8, 3),
    "sparse_vectors": f"""
        WITH {_CHUNKS}, stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM c),
        tf AS (SELECT doc_id, chunk_index, length, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, len(terms) AS length, unnest(terms) AS term FROM c) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        w AS (SELECT doc_id, chunk_index, term, {sql.fixed("ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))", 6)} AS weight FROM tf JOIN df USING (term) CROSS JOIN stats)
        SELECT doc_id, chunk_index, count(*) AS terms, max(weight) AS largest, md5(string_agg(term || '=' || CAST(round(weight * 1e6) AS BIGINT), ',' ORDER BY term)) AS entries_md5 FROM w GROUP BY ALL
    """,
    "titled_bm25": f"""
        WITH c AS MATERIALIZED (SELECT doc_id, chunk_index, {sql.terms("source || chr(10) || chunk_text")} AS terms FROM ({sql.chunks()}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
        q AS MATERIALIZED (SELECT item_id AS query_id, {sql.term_set("'src' || (item_id % 20) || ' ' || text")} AS wanted FROM benchmark), qt AS MATERIALIZED (SELECT query_id, unnest(wanted) AS term FROM q), {_BM25}
        SELECT * FROM sparse WHERE rank <= {TOP_K}
    """,
    "rrf_fusion": f"""
        {_RANKED}, {_DENSE},
        f AS (
            SELECT query_id, doc_id, chunk_index, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(d.keyword, s.keyword) AS keyword, {sql.fixed("coalesce(0.65 / (60 + d.rank), 0) + coalesce(0.35 / (60 + s.rank), 0)", 8)} AS score
            FROM dense d FULL JOIN sparse s USING (query_id, doc_id, chunk_index)
        )
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sparse_rank NULLS LAST, dense_rank NULLS LAST, doc_id, chunk_index) AS rank FROM f) WHERE rank <= {TOP_K}
    """,
    "query_router": rf"""
        SELECT conv_id, turn, CASE WHEN turn > 0 AND sure >= 0.5 THEN 'compare' ELSE 'qa' END AS mode, {sql.fixed("sure")} AS confidence FROM (
            SELECT conv_id, turn, least(1, {" + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w} ELSE 0 END" for w, p in _SIGNALS)}) AS sure
            FROM (SELECT *, text AS t FROM conversations WHERE role = 'user')
        )
    """,
    "rank_lift": f"""
        {_RANKED}, {_HOLDERS}, {_RERANKED},
        b AS ({_metrics_sql(_BY_DOCUMENT, 3)}),
        a AS ({_metrics_sql("SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM reranked GROUP BY query_id, doc_id", 3)})
        SELECT query_id, {", ".join(f"CAST(round({x} * 10000) - round({y} * 10000) AS BIGINT) AS {n}" for x, y, n in (("a.ndcg", "b.ndcg", "ndcg_lift"), ("a.recall", "b.recall", "recall_lift"), ("a.mrr", "b.mrr", "mrr_lift"), ("b.noise", "a.noise", "noise_reduction")))}
        FROM a JOIN b USING (query_id)
    """,
    "noise_filtering": f"""
        {_RANKED}, {_HOLDERS}, {_RERANKED},
        noise AS (SELECT DISTINCT query_id, doc_id FROM sparse ANTI JOIN held USING (query_id, doc_id)),
        kept AS (SELECT DISTINCT query_id, doc_id, 1 AS kept FROM reranked WHERE rank <= {TOP_K})
        SELECT query_id, count(*) AS noise_before, count(*) - count(kept) AS filtered, {sql.fixed("(count(*) - count(kept)) / count(*)")} AS rate
        FROM noise LEFT JOIN kept USING (query_id, doc_id) GROUP BY query_id
    """,
    "qa_confidence": f"""
        {_RANKED}, {_RERANKED},
        e AS (SELECT query_id, r.score >= 0.32 AS strong, r.score >= 0.32 * 0.8 AS weak, {sql.fixed("len(list_intersect(wanted, terms)) / len(wanted)", 6)} >= 0.51 AS enough FROM reranked r JOIN c USING (doc_id, chunk_index) JOIN q USING (query_id) WHERE rank <= {TOP_K}),
        n AS (SELECT query_id, count(*) FILTER (strong AND enough) AS s, count(*) FILTER (weak AND enough) AS w FROM e GROUP BY query_id)
        SELECT query_id, coalesce(s > 0 OR w > 0, false) AS confident, CASE WHEN s > 0 THEN s ELSE coalesce(w, 0) END AS usable, CAST(0 AS BIGINT) AS missing,
               CASE WHEN s > 0 OR w > 0 THEN NULL ELSE 'low_relevance' END AS failure FROM q LEFT JOIN n USING (query_id)
    """,
    "multi_query_merge": f"""
        WITH parts AS (
            SELECT item_id AS question_id, unnest([0, 1, 2]) AS sub_query, unnest([text, substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)), substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1)]) AS part FROM benchmark
        ),
        t AS (SELECT question_id, sub_query, len({sql.term_set("part")}) AS wanted, unnest({sql.term_set("part")}) AS term FROM parts),
        k AS (
            SELECT question_id, sub_query, doc_id, {sql.fixed("count(*) / wanted", 6)} AS keyword
            FROM (SELECT doc_id, unnest({sql.term_set("text")}) AS term FROM documents) JOIN t USING (term) GROUP BY question_id, sub_query, doc_id, wanted
        ),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id, sub_query ORDER BY keyword DESC, doc_id) AS position FROM k QUALIFY position <= {TOP_K}),
        m AS (SELECT question_id, doc_id, max_by(keyword, (keyword * 3, -sub_query)) AS score, max_by(sub_query, (keyword * 3, -sub_query)) AS from_query, min((sub_query, position)) AS seen FROM r GROUP BY question_id, doc_id)
        SELECT question_id, doc_id, score, score AS keyword, CAST(from_query AS BIGINT) AS from_query, row_number() OVER (PARTITION BY question_id ORDER BY seen, doc_id) AS place FROM m
    """,
    "minmax_rerank": f"""
        {_RANKED},
        m AS (
            SELECT query_id, doc_id, chunk_index, s.score AS original,
                   len(list_intersect(wanted, list_distinct(terms))) / (len(wanted) + len(list_distinct(terms)) - len(list_intersect(wanted, list_distinct(terms)))) AS model
            FROM sparse s JOIN c USING (doc_id, chunk_index) JOIN q USING (query_id)
        ),
        w AS (SELECT *, min(model) OVER (PARTITION BY query_id) AS low, max(model) OVER (PARTITION BY query_id) AS high FROM m),
        again AS (SELECT query_id, doc_id, chunk_index, original, {sql.fixed("CASE WHEN high > low THEN (model - low) / (high - low) ELSE model END", 6)} AS rerank FROM w),
        mixed AS (SELECT *, {sql.fixed("original * 0.4 + rerank * 0.6", 6)} AS score FROM again)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rerank DESC, original DESC, doc_id, chunk_index) AS rank FROM mixed) WHERE rank <= {TOP_K}
    """,
    "ranking_metrics": f"{_RANKED}, {_HOLDERS} {_metrics_sql(_BY_DOCUMENT, TOP_K)}",
    "sweep_score": f"""
        {_RANKED}, {_HOLDERS},
        m AS ({" UNION ALL ".join(f"SELECT 'top{k}' AS variant, * FROM ({_metrics_sql(_BY_DOCUMENT, k)}) WHERE query_id IN (SELECT query_id FROM held)" for k in (1, 3, 6))})
        SELECT variant, queries, {sql.fixed("ndcg * 40 + recall * 25 + mrr * 20 + coalesce(precision, 0) * 10 + coalesce(quiet, 0) * 5", 3)} AS score FROM (
            SELECT variant, count(*) AS queries, {sql.fixed("avg(ndcg)")} AS ndcg, {sql.fixed("avg(recall)")} AS recall, {sql.fixed("avg(mrr)")} AS mrr,
                   {sql.fixed("avg(precision)")} AS precision, {sql.fixed("avg(1 - noise)")} AS quiet FROM m GROUP BY variant
        )
    """,
    "missing_from_best": f"{_RANKED}, {_HOLDERS} SELECT query_id, doc_id FROM held ANTI JOIN (SELECT * FROM sparse WHERE rank = 1) s USING (query_id, doc_id)",
    "missing_documents": f"{_RANKED}, {_HOLDERS} SELECT query_id, doc_id FROM held ANTI JOIN (SELECT * FROM sparse WHERE rank <= {TOP_K}) s USING (query_id, doc_id)",
    "near_duplicate_pairs": f"""
        {_RANKED}, {_PAIRS}
        SELECT group_id, left_doc, right_doc, {sql.fixed("j")} AS term_jaccard, {sql.fixed("o")} AS sentence_overlap, j >= 0.75 AND o >= 0.6 AS near_duplicate,
               j >= 0.85 AND o >= 0.75 AS strong_near_duplicate, only_left, only_right FROM pairs
    """,
}
