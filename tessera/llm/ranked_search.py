"""Ranked lexical search over shards of compressed postings, document at a time.

  1. Each task cuts its documents into shards. A shard is one row: its document ids in order, their
     lengths, and for each term a posting list of places in that order and of counts, as gaps of
     seven-bit digits. Only terms that some query asks for are listed, unless there are too many of
     them; lengths and the corpus totals cover all terms.
  2. Totals and document frequencies are aggregated from the shards.
  3. For each query the lists of its terms are merged by a heap on the next document of each list. A
     document met at the top is scored whole and goes on a bounded heap keyed by score, then by id. A
     list whose best impact, with those of all weaker lists, is below the worst kept score can't bring
     a document in by itself: such lists leave the merge and are only looked up for documents that
     others bring. Bounds are exact integers, so no document is lost. The heap of a query lasts over all
     shards of a task.
  4. The best of each task are ranked together.

Queries go out in blocks of bounded size (BLOCK_TERMS terms with repeats), each against all shards.

Defined results: a null text has no terms; a document without id counts in all totals and ranks behind
equal scores with an id, its doc_id is null; rows of one id are documents of their own; equal rows of
the query table count once; a query without terms has no results; an empty table gives no results;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table
from tessera.llm.terms import BEYOND_ASCII, DIGITS, LETTERS, folding, packed, term_lists, text_column, unpacked
from tessera.llm.words import slices

TERM_BYTES = folding(LETTERS + LETTERS.upper() + DIGITS + BEYOND_ASCII)
SHARD_DOCUMENTS, SHARD_BYTES = 1 << 13, 1 << 26
#: Asked terms that are sent to the tasks that build shards; beyond that all terms are listed.
MAX_ASKED = 200_000
BLOCK_TERMS = 100_000
NO_ID = (1 << 63) - 1
SHARD = "n_documents long, n_terms long, ids binary, lengths binary, terms array<string>, frequencies array<long>, postings array<binary>"


class Shard:
    """Documents gathered until the shard is full."""

    def __init__(self):
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.bytes = 0

    def add(self, doc_id: int, text: bytes, asked: frozenset | None) -> None:
        counts: Counter = Counter()
        for words in term_lists(text, TERM_BYTES):
            counts.update(words)
        self.bytes += len(text)
        if not counts:
            return
        place = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        for term in counts if asked is None else counts.keys() & asked:
            self.postings.setdefault(term, []).append((place, counts[term]))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCUMENTS or self.bytes >= SHARD_BYTES

    def row(self) -> pa.RecordBatch:
        ids = np.array(self.ids, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        terms = sorted(self.postings)
        lists = []
        for term in terms:
            pairs = np.array(self.postings[term], np.int64)
            at = place[pairs[:, 0]]
            turn = np.argsort(at)
            lists.append(packed(np.concatenate([np.diff(at[turn], prepend=0), pairs[turn, 1]])))
        gaps = np.diff(ids[order].astype(np.uint64), prepend=np.uint64(0))
        columns = [
            pa.array([len(ids)], pa.int64()),
            pa.array([sum(self.lengths)], pa.int64()),
            pa.array([packed(gaps)], pa.binary()),
            pa.array([packed(np.array(self.lengths, np.int64)[order])], pa.binary()),
            pa.array([[t.decode() for t in terms]], pa.list_(pa.string())),
            pa.array([[len(self.postings[t]) for t in terms]], pa.list_(pa.int64())),
            pa.array([lists], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARD.split(", ")])


def build_shards(docs: DataFrame, asked: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each shard of documents with terms; with asked, only those terms are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value if asked else None
        shard = Shard()
        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch.column(1))):
                shard.add(NO_ID if doc_id is None else doc_id, text, wanted)
                if shard.full():
                    if shard.ids:
                        yield shard.row()
                    shard = Shard()
        if shard.ids:
            yield shard.row()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SHARD)


def query_terms(text: str | None) -> Counter:
    counts: Counter = Counter()
    for words in term_lists((text or "").encode(), TERM_BYTES):
        counts.update(words)
    return counts


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Searcher:
    """Queries over shards, one after another; keeps the k best of each query."""

    def __init__(self, queries: list[tuple[int, dict[bytes, int]]], weights: dict[bytes, int], totals: tuple[int, int], k: int):
        self.queries = [(name, {t: n * weights[t] for t, n in terms.items() if weights.get(t)}) for name, terms in queries]
        self.asked = {t for _, terms in self.queries for t in terms}
        (self.documents, self.length), self.k = totals, k
        self.best: dict[int, list[tuple[int, int]]] = {name: [] for name, _ in self.queries}

    def search(self, shard: dict) -> None:
        ids = unpacked(shard["ids"]).cumsum(dtype=np.uint64).astype(np.int64)
        slow = 12 * (75 + 25 * unpacked(shard["lengths"]).astype(np.int64) * self.documents // self.length)
        lists: dict[bytes, tuple[list[int], list[int], int]] = {}
        for term, frequency, data in zip(shard["terms"], shard["frequencies"], shard["postings"]):
            key = term.encode()
            if key in self.asked:
                values = unpacked(data).astype(np.int64)
                at, count = values[:frequency].cumsum(), values[frequency:]
                impact = 1_000_000_000 * count // (1000 * count + slow[at])
                lists[key] = at.tolist(), impact.tolist(), int(impact.max())
        names = ids.tolist()
        for name, terms in self.queries:
            merge([(w, *lists[t]) for t, w in terms.items() if t in lists], names, self.best[name], self.k)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for name, best in self.best.items():
            for score, low in best:
                yield name, -low, score


def merge(lists: list[tuple[int, list[int], list[int], int]], names: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Adds the documents of one shard to best, a heap of (score, -id) of at most k.

    lists: for each term its weight, the places of its documents, their impacts and the highest of these.
    """
    lists.sort(key=lambda x: x[0] * x[3])
    bounds, sums = [], 0
    for weight, _, _, highest in lists:
        sums += weight * highest
        bounds.append(sums)
    weights, places, impacts = ([x[i] for x in lists] for i in range(3))
    cursors, ends = [0] * len(lists), [len(p) for p in places]
    worst = best[0][0] if len(best) == k else 1
    first = bisect_left(bounds, worst)  # lists before this can't reach the worst kept score together
    n = len(lists)
    heap = [places[j][0] * n + j for j in range(first, n)]
    heapq.heapify(heap)
    while heap:
        place = heap[0] // n
        score = 0
        while heap and heap[0] // n == place:
            j = heap[0] % n
            at = cursors[j]
            score += weights[j] * impacts[j][at]
            cursors[j] = at = at + 1
            if at < ends[j]:
                heapq.heapreplace(heap, places[j][at] * n + j)
            else:
                heapq.heappop(heap)
        for j in range(first - 1, -1, -1):
            if score + bounds[j] < worst:
                break
            at = bisect_left(places[j], place, cursors[j])
            cursors[j] = at
            if at < ends[j] and places[j][at] == place:
                score += weights[j] * impacts[j][at]
        else:
            if score >= worst:
                entry = score, -names[place]
                if len(best) < k:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
                if len(best) == k and best[0][0] > worst:
                    worst = best[0][0]
                    if bounds[first] < worst:
                        first = bisect_left(bounds, worst)
                        heap = [h for h in heap if h % n >= first]
                        heapq.heapify(heap)


def best_matches(shards: DataFrame, queries: list[tuple[int, dict[bytes, int]]], totals: tuple[int, int], frequencies: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score: the k best of each query and task."""
    spark = shards.sparkSession
    asked = spark.createDataFrame([(t.decode(),) for t in sorted({t for _, terms in queries for t in terms})], "term string")
    weights = {r["term"].encode(): term_weight(totals[0], r["frequency"]) for r in frequencies.join(F.broadcast(asked), "term").collect()}
    sent = spark.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*sent.value, totals, k)
        for batch in batches:
            for i in range(batch.num_rows):
                searcher.search(batch.slice(i, 1).to_pylist()[0])
        rows = list(searcher.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query", "doc_id", "score"])

    return shards.mapInArrow(run, "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, max_asked: int = MAX_ASKED) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest above 0 for each query."""
    spark = docs.sparkSession
    asks = queries.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{query_col}`").alias("query_text")).distinct()
    size = F.sum(F.length("query_text")).alias("size")
    blocks = max(1, math.ceil((asks.agg(size).first()["size"] or 0) / 2 / block_terms))  # a term and its end take two characters at least
    asks = stored(asks.withColumn("block", F.pmod(F.xxhash64("item_id", "query_text"), F.lit(blocks))))
    asked = None
    if blocks * block_terms <= 50 * max_asked:
        counts: set = set()
        for block in range(blocks):
            for row in asks.where(F.col("block") == block).collect():
                counts |= query_terms(row["query_text"]).keys()
            if len(counts) > max_asked:
                break
        else:
            asked = spark.sparkContext.broadcast(frozenset(counts))
    shards = stored(build_shards(docs, asked, id_col, text_col))
    total = shards.agg(F.sum("n_documents").alias("n"), F.sum("n_terms").alias("l")).first()
    pair = F.explode(F.arrays_zip("terms", "frequencies")).alias("x")
    frequencies = shards.select(pair).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.frequencies").alias("frequency"))
    found = None
    for block in range(blocks):
        rows = asks.where(F.col("block") == block).collect() if total["n"] else []
        if not rows:
            continue
        numbered = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {asks.schema['item_id'].dataType.simpleString()}")
        terms = [(i, dict(query_terms(r["query_text"]))) for i, r in enumerate(rows)]
        matches = best_matches(shards, terms, (total["n"], total["l"]), frequencies, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(numbered), "query").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {asks.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return found


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
QUERIES = {"op12_ranked_search": op12_ranked_search}
ORACLES = {
    "op12_ranked_search": f"""
        WITH counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
        totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
        weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
        slowness AS (SELECT doc_id, 100 - 25 + ((25 * n * big_n) // big_l) AS m FROM lengths, totals),
        asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
        scored AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN slowness USING (doc_id)
            GROUP BY item_id, doc_id
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """
}
