"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (words given, and words learned from the labels), how near hits
lie to second-person words, capitals, punctuation, and obfuscation rates (hits that appear only
when look-alike characters are read as letters, repeated letters, symbols inside words). Words are
runs of Unicode letters in lower case, cut by one tokenizer for learning and scoring alike. The
learned lexicon is every word in at least `least` toxic rows whose share among them is `odds` times
that among others; it is learned from one half of the labelled rows, so that trees fitted on all
see how its hits fare on rows it was not learned from. Trees and calibration are fitted with Spark
ML on a sample of at most about max_rows labelled rows, split by a hash of their ids; features and
scores are computed for every whole text.

Defined results: null and empty texts have all-zero features and get a score like any other; a
sample with one class gives that class's share to every row; a repeated label counts once, toxic
if any says so; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, fold, table
from tessera.llm.features import CodePoints, LetterWords, per_row, shares, unicode, word_hash
from tessera.llm.words import Words, slices

#: A small general list; the learned lexicon adds to it.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "vermin", "hate", "kill", "shut", "ugly", "filth"]
SECOND_PERSON = ["you", "your", "yours", "yourself", "ur", "u", "tu", "toi", "ton", "ta", "te", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "ti", "tus"]
NEAR = 5
#: Characters that stand between letters in ordinary text: white space, hyphens, apostrophes.
JOINING = np.zeros(0x2020, bool)
JOINING[[32, *range(9, 14), 0x27, 0x2D, 0xA0, 0xAD, *range(0x2000, 0x2016), 0x2018, 0x2019]] = True


def lexicon_of(labelled: DataFrame, least: int = 5, odds: float = 8.0) -> list[tuple[int, float]]:
    """Hashes of the learned words, with the logarithm of their odds; the sample bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words = LetterWords(CodePoints(batch.column(1)))
            row = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
            each = np.unique(np.stack([row.astype(np.uint64), words.hash]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each[0].astype(np.int64))), pa.array(each[1].view(np.int64))], ["toxic", "word"])

    words = labelled.select("toxic", "text").mapInArrow(run, "toxic int, word long")
    sums = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(F.col("bad") >= least)
    total = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("good")).first()
    ratio = ((F.col("bad") + 0.5) / (total["bad"] + 1)) / ((F.col("good") + 0.5) / (total["good"] + 1))
    rows = sums.withColumn("odds", ratio).where(F.col("odds") >= odds).collect()
    return [(r["word"] & ((1 << 64) - 1), float(np.log(r["odds"]))) for r in rows]


def feature_matrix(texts: pa.Array, lexicon: np.ndarray, weights: np.ndarray, listed: np.ndarray, person: np.ndarray) -> np.ndarray:
    """One row of features per text. lexicon: sorted hashes with weights; listed: sorted hashes."""
    words, text = Words(texts), CodePoints(texts)
    plain, written = LetterWords(text), LetterWords(text, lookalike=True)
    n = np.maximum(1, np.diff(plain.first)).astype(float)

    def found(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), int)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return table[at] == hashes, at

    hit, at = found(lexicon, plain.hash)
    in_list, _ = found(listed, plain.hash)
    you, _ = found(person, plain.hash)
    weight = np.where(hit, weights[at] if len(weights) else 0.0, 0.0)
    any_hit = hit | in_list
    row = np.repeat(np.arange(words.rows), np.diff(plain.first))
    near = np.zeros(len(you), bool)
    for step in range(-NEAR, NEAR + 1):
        a, b = max(0, -step), max(0, step)
        k = len(you) - abs(step)
        if k > 0:
            near[a : a + k] |= you[b : b + k] & (row[a : a + k] == row[b : b + k])
    all_hits = np.maximum(1, per_row(any_hit, plain.first))
    undone, _ = found(np.union1d(lexicon, listed), written.hash)
    hidden = np.maximum(0, per_row(undone, written.first) - per_row(any_hit, plain.first))
    known, points = unicode(), text.points
    letter, capital = known.letter[points], known.capital[points]
    inside = np.zeros(len(points), bool)
    if len(points) > 2:
        inside[1:-1] = ~letter[1:-1] & ~JOINING[np.minimum(points[1:-1], len(JOINING) - 1)] & letter[:-2] & letter[2:]
    letters = np.maximum(1, per_row(letter, text.offsets))
    columns = [
        per_row(any_hit, plain.first),
        per_row(any_hit, plain.first) / n,
        per_row(in_list, plain.first) / n,
        per_row(weight, plain.first),
        per_row(weight, plain.first) / n,
        per_row(near & any_hit, plain.first) / all_hits,
        per_row(you, plain.first) / n,
        hidden,
        hidden / n,
        per_row(inside, text.offsets) / n,
        per_row(capital, text.offsets) / letters,
    ]
    return np.nan_to_num(np.concatenate([np.stack(columns, 1), shares(words)], 1))


def with_features(docs: DataFrame, lexicon: list[tuple[int, float]], carried: str = "") -> DataFrame:
    """docs (doc_id, text, then the carried columns) with an array of features for the text."""
    known = sorted(lexicon)
    hashes, weights = np.array([h for h, _ in known], np.uint64), np.array([x for _, x in known], float)
    listed, person = (np.unique(np.array([word_hash(w) for w in ws], np.uint64)) for ws in (INSULTS, SECOND_PERSON))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            matrix = feature_matrix(batch.column("text"), hashes, weights, listed, person)
            offsets = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), array], [*rest, "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}{carried}, features array<double>")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and the label of about max_rows rows at most, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    total = known.count()
    part = int(min(1.0, max_rows / max(1, total)) * 1_000_000)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds chosen


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """doc_id, score. labels: doc_id, toxic (0 or 1), already restricted to training rows."""
    sample = labelled_sample(docs, labels, "toxic", max_rows)
    lexicon = lexicon_of(sample.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)) == 0))
    rows = with_features(sample.select("doc_id", "text", "toxic"), lexicon, ", toxic int")
    rows = checkpointed(rows.select("doc_id", F.col("toxic").cast("double").alias("toxic"), array_to_vector("features").alias("features")))
    part = F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(4))
    counts = {(r["part"], r["toxic"]): r["count"] for r in rows.groupBy((part == 0).alias("part"), "toxic").count().collect()}
    scored = with_features(docs.select("doc_id", "text"), lexicon).select("doc_id", array_to_vector("features").alias("features"))
    if any(not counts.get((p, t)) for p in (True, False) for t in (0.0, 1.0)):
        bad = sum(n for (_, t), n in counts.items() if t == 1.0)
        return scored.select("doc_id", F.lit(bad / max(1, sum(counts.values()))).alias("score"))
    model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(rows.where(part != 0))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    held = model.transform(rows.where(part == 0)).select("toxic", margin)
    level = IsotonicRegression(featuresCol="margin", labelCol="toxic").fit(held)
    scored = level.transform(model.transform(scored).select("doc_id", margin))
    return scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    scored = score_toxicity(docs, labels.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
