"""Near-duplicate classes by DartMinHash signatures and banded joining.

Every document is a weighted set of shingles of five words. Darts are thrown at the plane of
weight and rank over each shingle: a cell of the plane holds a Poisson number of darts, fixed by a
hash of shingle and cell, and each dart has a place in the cell and a coordinate of the signature.
A document sees the darts below its weights up to a rank that grows as its total weight shrinks,
so that all documents see about as many; the dart of least rank in each coordinate is its
signature there. Two signatures agree in a coordinate with the weighted Jaccard similarity.

Documents that agree in a whole band are candidates:
  1. documents with the same shingles are folded into one representative;
  2. in each bucket the least id leads; each member is compared with its leader;
  3. links (similarity of at least `threshold`, exact over all shingles, which count as equal when
     their 61-bit hashes agree) are closed to classes;
  4. in a bucket of three and more that still holds several classes, those outside its largest
     class are compared with all of that class and with each other, in blocks of bounded size.
So each pair of a bucket is compared, or its members share a class by other links. Copies are
never paired.

With 24 bands of 4 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.

Defined results: null and empty texts, and texts without words, are classes of their own id; texts
of one to four words have one shingle, their words; rows without id (or with 2**63 - 1, which
stands for none) have no class and size 1; rows
of one id are one document (of differing texts, that with the greatest shingle bytes is compared);
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, fresh, table
from tessera.llm.words import ODD, Words, mix64, range_hashes, slices

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
NO_ID = (1 << 63) - 1
_poisson: dict[float, np.ndarray] = {}


def poisson_cdf(mean: float) -> np.ndarray:
    """P(count <= i) of a Poisson variable, as far as doubles tell it from 1."""
    if mean not in _poisson:
        top = int(mean + 12 * np.sqrt(mean) + 30)
        logs = np.arange(top + 1) * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, top + 1)))])
        _poisson[mean] = np.cumsum(np.exp(logs))
    return _poisson[mean]


def fraction(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to below 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def throw_darts(row: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, identity, rank and a second hash of each dart that a row sees.

    row, element (hash) and weight describe the sets; reach[row] is the rank up to which it sees.
    Cells double: weights [0, 1), [1, 2), [2, 4), ..., ranks [0, 1/2), [1/2, 1), [1, 2), ...
    """
    found = []
    limit = reach[row]
    for v in range(max(0, int(np.ceil(np.log2(weight.max())))) + 1 if len(weight) else 0):
        low_w, high_w = (0.0, 1.0) if not v else (2.0 ** (v - 1), 2.0**v)
        for j in range(max(0, int(np.ceil(np.log2(limit.max()))) + 1) + 1):
            low_r, high_r = (0.0, 0.5) if not j else (2.0 ** (j - 2), 2.0 ** (j - 1))
            there = np.flatnonzero((weight > low_w) & (limit > low_r))
            if not len(there):
                continue
            seed = mix64(element[there] + np.uint64((v * 64 + j + 1) * int(ODD) & ((1 << 64) - 1)))
            n = np.searchsorted(poisson_cdf((high_w - low_w) * (high_r - low_r)), fraction(seed), side="right")
            owner = np.repeat(there, n)
            if not len(owner):
                continue
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix64(np.repeat(seed, n) + (turn + 1).astype(np.uint64) * ODD)
            second = mix64(dart ^ np.uint64(0x5851F42D4C957F2D))
            rank = low_r + fraction(dart) * (high_r - low_r)
            at = low_w + (second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * (high_w - low_w)
            seen = (at < weight[owner]) & (rank < limit[owner])
            found.append((row[owner[seen]], dart[seen], rank[seen], second[seen]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, size: int = BANDS * ROWS) -> np.ndarray:
    """[rows, size] identities of the least dart in each coordinate; every row needs an element.

    Rows with an empty coordinate see farther until none is left; that changes no other one.
    """
    total = np.bincount(row, weight, rows)
    sight = size * (np.log(size) + 4)
    out = np.zeros((rows, size), np.uint64)
    todo = np.unique(row)
    while len(todo):
        place = np.full(rows, -1)
        place[todo] = np.arange(len(todo))
        mine = place[row] >= 0
        reach = sight / total[todo]
        r, dart, rank, second = throw_darts(place[row[mine]], element[mine], weight[mine], reach)
        key = r * size + ((second >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        best = np.full(len(todo) * size, np.inf)
        np.minimum.at(best, key, rank)
        won = rank == best[key]
        got = np.zeros(len(todo) * size, np.uint64)
        got[key[won]] = dart[won]
        out[todo] = got.reshape(-1, size)
        todo = todo[np.isinf(best).reshape(-1, size).any(1)]
        sight *= 2
    return out


def shingle_sets(words: Words, weights: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct shingle, sorted by row and hash.

    weights is "set" (1 each) or "count" (occurrences in the document).
    """
    hashes = words.hashes()
    at, grams = words.grams(SHINGLE, hashes)
    row = words.row[at]
    short = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < SHINGLE))
    row = np.concatenate([row, short])
    grams = np.concatenate([grams, range_hashes(hashes, words.first[short], words.first[short + 1])])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(row)))
    return row[starts], grams[starts], counts.astype(float) if weights == "count" else np.ones(len(starts))


def sketch(docs: DataFrame, weights: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, same1 and same2 (128 bits of the weighted set) and buckets (one hash per band),
    null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = Words(batch.column(1))
            row, element, weight = shingle_sets(words, weights)
            signed = signatures(row, element, weight, words.rows)
            mixed = mix64(element + weight.astype(np.uint64) * ODD)
            first = np.searchsorted(row, np.arange(words.rows + 1))
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mixed, mix64(mixed))]
            same = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
            powers = np.array([int(ODD) ** (i + 1) & ((1 << 64) - 1) for i in range(ROWS)], np.uint64)
            bands = mix64((signed.reshape(words.rows, BANDS, ROWS) * powers).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
            empty = np.diff(first) == 0
            offsets = pa.array(np.arange(words.rows + 1, dtype=np.int32) * BANDS)
            buckets = pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()), mask=pa.array(empty))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same[0]), pa.array(same[1]), buckets], ["doc_id", "same1", "same2", "buckets"])

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, same1 long, same2 long, buckets array<long>")


def shingle_blobs(docs: DataFrame, ids: DataFrame, weights: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its sorted shingle hashes (and counts) as bytes, for those ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            words = Words(batch.column(1))
            row, element, weight = shingle_sets(words, weights)
            first = np.searchsorted(row, np.arange(words.rows + 1)).tolist()
            if weights == "count":
                blobs = [element[a:b].tobytes() + weight[a:b].astype(np.uint32).tobytes() for a, b in zip(first, first[1:])]
            else:
                blobs = [element[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary").groupBy("doc_id").agg(F.max("shingles").alias("shingles"))


def counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a blob that has both."""
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n).astype(np.int64)


def jaccard(a: bytes, b: bytes, weights: str) -> float:
    if weights == "count":
        (x, n), (y, m) = counted(a), counted(b)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], m[j]).sum())
        return both / max(1, int(n.sum()) + int(m.sum()) - both)
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / max(1, len(both) - same)


def links_among(pairs: DataFrame, blobs: DataFrame, weights: str, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [jaccard(x.as_py(), y.as_py(), weights) >= threshold for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = blobs.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = blobs.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def close(links: DataFrame) -> DataFrame:
    """(node, class_id) for every node of the links (a, b): alternating large and small stars."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id"))
        before = now


def overlaps(own: np.ndarray, values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of own's shingles each of n sets holds; values are all of theirs, sorted."""
    low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
    size = high - low
    index = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.bincount(owner[index], minlength=n)


def links_to_main(minors: DataFrame, members: DataFrame, blobs: DataFrame, weights: str, threshold: float, block: int = 256) -> DataFrame:
    """Links (a, b) between minors and members of one main class (columns main, doc_id, class_id).

    Both sides are dealt into blocks, and each block of minors meets each block of members in a
    group of its own of about twice `block` rows. Of the links of a minor to one class in a group,
    the strongest stands for all.
    """
    sizes = minors.groupBy("main").agg(F.count(F.lit(1)).alias("m")).join(members.groupBy("main").agg(F.count(F.lit(1)).alias("n")), "main")
    sizes = sizes.select("main", F.ceil(F.col("m") / block).cast("int").alias("m"), F.ceil(F.col("n") / block).cast("int").alias("n"))
    turn = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    full = lambda side: side.join(sizes, "main").join(blobs, "doc_id")
    columns = ["main", "i", "j", "is_minor", "doc_id", "class_id", "shingles"]
    left = full(minors).withColumns({"i": turn("m"), "is_minor": F.lit(True)}).withColumn("j", every("n")).select(columns)
    right = full(members).withColumns({"j": turn("n"), "is_minor": F.lit(False)}).withColumn("i", every("m")).select(columns)

    def compare(group: pa.Table) -> pa.Table:
        is_minor = np.asarray(group["is_minor"])
        ids, classes, blob = np.asarray(group["doc_id"]), np.asarray(group["class_id"]), group["shingles"].to_pylist()
        theirs = np.flatnonzero(~is_minor)
        found = []
        if len(theirs) and weights == "set":
            sets = [np.frombuffer(blob[k], np.uint64) for k in theirs]
            size = np.array([len(x) for x in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
        for k in np.flatnonzero(is_minor) if len(theirs) else []:
            if weights == "set":
                own = np.frombuffer(blob[k], np.uint64)
                both = overlaps(own, values, owner, len(theirs))
                alike = both / np.maximum(1, len(own) + size - both)
            else:
                alike = np.array([jaccard(blob[k], blob[t], weights) for t in theirs])
            seen = set()
            for t in np.argsort(-alike, kind="stable"):
                if alike[t] < threshold:
                    break
                other = classes[theirs[t]]
                if other != classes[k] and other not in seen:
                    seen.add(other)
                    found.append((int(ids[k]), int(ids[theirs[t]])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).groupBy("main", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), class_size."""
    sketches = checkpointed(sketch(docs, weights, id_col, text_col))
    with_words = sketches.where((F.col("doc_id") != NO_ID) & F.col("buckets").isNotNull())
    groups = with_words.groupBy("same1", "same2").agg(F.min(F.struct("doc_id", "buckets")).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = checkpointed(groups.select("same1", "same2", "copies", "first.*"))
    entries = groups.select(F.explode("buckets").alias("bucket"), "doc_id")
    leaders = entries.groupBy("bucket").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = checkpointed(entries.join(leaders, "bucket"))
    pairs = shared.where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    blobs = checkpointed(shingle_blobs(docs, shared.select("doc_id").distinct(), weights, id_col, text_col))
    links = checkpointed(links_among(pairs, blobs, weights, threshold))
    classes = close(links)
    # buckets of three and more that hold several classes
    named = shared.where("n > 2").join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sizes = named.groupBy("bucket", "class_id").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("class_id", F.struct("n", -F.col("class_id"))).alias("main")).where("kinds > 1").select("bucket", "main")
    minors = checkpointed(named.join(mixed, "bucket").where("class_id != main").select("main", "doc_id", "class_id").distinct())
    if not minors.isEmpty():
        mains = minors.select("main").distinct()
        of_main = shared.select("doc_id").distinct().join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        of_main = of_main.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
        members = of_main.join(mains, F.col("class_id") == F.col("main")).select("main", "doc_id", "class_id").unionByName(minors)
        found = checkpointed(links_to_main(minors, members, blobs, weights, threshold))
        if not found.isEmpty():
            classes = close(links.unionByName(found))
    chosen = groups.select("same1", "same2", "copies", F.col("doc_id").alias("node")).join(classes, "node", "left")
    chosen = chosen.select("same1", "same2", "copies", F.coalesce("class_id", "node").alias("class_id"))
    sizes = chosen.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    chosen = checkpointed(chosen.join(sizes, "class_id"))
    members = with_words.select("doc_id", "same1", "same2").join(chosen, ["same1", "same2"]).select("doc_id", "class_id", "class_size")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    alone = sketches.where((F.col("doc_id") == NO_ID) | F.col("buckets").isNull())
    return members.unionByName(alone.select(real.alias("doc_id"), real.alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose id is the least of its class; rows without id stay."""
    classes = near_duplicate_classes(docs, threshold, id_col=id_col, text_col=text_col)
    key = fresh(docs, "gone_id")
    gone = classes.where("doc_id != class_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(key), "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        grams AS MATERIALIZED (
            SELECT DISTINCT doc_id, md5(array_to_string(words[k : k + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM d WHERE len(words) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE k >= 0.8 * (sx.n + sy.n - k)),
        edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN edges ON r = x),
        classes AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id)
        SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM classes
    """
}
