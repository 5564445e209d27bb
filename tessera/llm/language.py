r"""Language ID by mixture inference.

Every learned language has a distribution over hashed byte trigrams. A document is a mixture: each
of its words was drawn from one language, with a likelihood that is the product over the word's
trigrams. Expectation-maximisation, run to a tolerance, estimates the proportions; the set of
languages is the best single one or the first two, three, ... or all learned ones in the order of
the unrestricted proportions: that whose log-likelihood less log(words) / 2 for each further
language is greatest. A row stops growing only where the bound of its unrestricted likelihood shows
that no larger set can be better.

The score is the greatest share as the mean over all sets tried, weighted by that likelihood, so it
is low both for mixed texts and for texts too short to tell.

Counts are taken over all training rows; the model is languages x BUCKETS numbers, however large
the corpus.

Defined results: text that is null or has no letter, or a model without languages, gives und with
score 0 (letters are \p{L}: numerals such as fractions are none); ties go to the language first in order; repeated rows each get the same result; empty
tables give empty results; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, table
from tessera.llm.features import LETTER, LOWER, CodePoints, per_row, runs, unicode
from tessera.llm.words import Words, slices

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Log-likelihood a word that EM may leave unreached, and its rounds between two tests of that.
TOLERANCE = 1e-8
ROUNDS = 4


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    """For each byte the bucket of it and its neighbours, lower-cased, other than letters as one."""
    plain = np.where(LETTER, LOWER, 32).astype(np.uint32)[raw]
    around = np.concatenate([[np.uint32(32)], plain, [np.uint32(32)]]).astype(np.uint32)
    mixed = around[:-2] * np.uint32(0x9E3779B1) + around[1:-1] * np.uint32(0x85EBCA6B) + around[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)


def count_trigrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, bucket, n over all rows; each task sums before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            words = Words(batch.column(1))
            buckets = trigram_buckets(words.raw)
            letters = LETTER[words.raw]
            names, rows = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            owner = np.repeat(rows, np.diff(words.offsets))
            for k, name in enumerate(names):
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(buckets[letters & (owner == k)], minlength=BUCKETS)
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], ["lang", "bucket", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(lang_col, text_col).mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(counts: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probabilities [language, bucket], with add-half smoothing."""
    names = sorted(counts["lang"].unique())
    sums = np.full((len(names), BUCKETS), 0.5)
    sums[np.searchsorted(names, counts["lang"]) if len(names) else [], counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return names, np.log(sums / sums.sum(1, keepdims=True)).astype(np.float32)


def maximise(likelihood: np.ndarray, row: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares [row, language], and the log-likelihood per row. likelihood: [word,
    language], words of row r are first[r] to first[r + 1], and every row has some."""
    n = np.diff(first)[:, None]
    for step in range(rounds + 1):
        joint = likelihood * shares[row]
        total = joint.sum(1)
        if step == rounds:
            return shares, np.add.reduceat(np.log(np.maximum(total, 1e-30)), first[:-1])
        joint /= np.maximum(total, 1e-30)[:, None]
        shares = np.add.reduceat(joint, first[:-1], axis=0) / n
    return shares, total


def converge(likelihood: np.ndarray, first: np.ndarray, shares: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM until no shares of these languages could raise a row's log-likelihood by more than
    TOLERANCE a word, or could lift it above enough[row]. Gives the shares, the log-likelihood and
    its upper bound: the logarithm is concave, so with gain k the mean over the words of likelihood
    k / likelihood of the mixture, no mixture adds more than words * log(greatest gain)."""
    shares = shares.astype(float)
    out, value, bound = shares.copy(), np.zeros(len(shares)), np.zeros(len(shares))
    live, n = np.arange(len(shares)), np.diff(first)
    row = np.repeat(live, n)
    while len(live):
        shares, reached = maximise(likelihood, row, first, shares, ROUNDS)
        total = np.maximum((likelihood * shares[row]).sum(1), 1e-30)
        gain = np.add.reduceat(likelihood / total[:, None], first[:-1], axis=0) / n[:, None]
        more = np.log(np.maximum(gain.max(1), 1))
        out[live], value[live], bound[live] = shares, reached, reached + n * more
        going = (more > TOLERANCE) & (bound[live] > enough[live])
        if not going.all():
            likelihood, shares, live, n = likelihood[going[row]], shares[going], live[going], n[going]
            first, row = np.concatenate([[0], np.cumsum(n)]), np.repeat(np.arange(len(n)), n)
    return out, value, bound


def infer(words: Words, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the languages per row; whether a row has a word at all; and how sure the greatest
    share is: its mean over all sets tried, each weighted by its penalised likelihood."""
    start, end = runs(LETTER[words.raw], words.offsets)
    every = np.searchsorted(start, words.offsets)
    some = np.diff(every) > 0
    languages = len(log_p)
    out = np.zeros((words.rows, languages))
    if not some.any() or not languages:
        return out, some & bool(languages), np.zeros(words.rows)
    buckets = trigram_buckets(words.raw)
    scores = np.empty((len(start), languages))
    for k in range(languages):
        sums = np.concatenate([[0], np.cumsum(log_p[k][buckets], dtype=np.float64)])
        scores[:, k] = sums[end] - sums[start]
    first = np.concatenate([every[:-1][some], every[-1:]])
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    penalty, least = np.log(n) / 2, n * TOLERANCE
    alone = np.add.reduceat(scores, first[:-1], axis=0)
    top = np.argmax(alone, 1)
    best = alone[np.arange(len(n)), top]
    shares = np.eye(languages)[top]
    base = scores.max(1)
    base_sum = np.add.reduceat(base, first[:-1])
    free, _, bound = converge(np.exp(scores - base[:, None]), first, np.full((len(n), languages), 1 / languages), best + penalty + least - base_sum)
    bound += base_sum
    ranked = np.argsort(-free, axis=1, kind="stable")
    tried = []
    for size in range(2, languages + 1):
        # no set's likelihood exceeds the bound of the unrestricted one: rows left out can't gain by any set of this size or more
        live = np.flatnonzero(bound - (size - 1) * penalty > best + least)
        if not len(live):
            break
        chosen, taken = ranked[live, :size], np.isin(row, live)
        own = np.repeat(np.arange(len(live)), n[live])
        of_set = np.take_along_axis(scores[taken], chosen[own], 1)
        top_of_set = of_set.max(1)
        edges = np.concatenate([[0], np.cumsum(n[live])])
        base_of_set = np.add.reduceat(top_of_set, edges[:-1])
        start_at = np.maximum(np.take_along_axis(free[live], chosen, 1), 1e-6)
        must = best[live] + (size - 1) * penalty[live] + least[live]
        found, value, _ = converge(np.exp(of_set - top_of_set[:, None]), edges, start_at / start_at.sum(1, keepdims=True), must - base_of_set)
        value += base_of_set
        tried.append((live, chosen, found, value - (size - 1) * penalty[live]))
        better = value > must
        at = live[better]
        shares[at] = 0
        shares[at[:, None], chosen[better]] = found[better]
        best[at] = (value - (size - 1) * penalty[live])[better]
    out[some] = shares
    top = np.argmax(shares, 1)
    weight = np.exp(alone - best[:, None])
    sure, total = weight[np.arange(len(n)), top], weight.sum(1)
    for live, chosen, found, value in tried:
        weight = np.exp(np.minimum(value - best[live], 0))
        sure[live] += weight * np.where(chosen == top[live][:, None], found, 0).sum(1)
        total[live] += weight
    score = np.zeros(words.rows)
    score[some] = sure / total
    return out, some, score


def identify(docs: DataFrame, names: list[str], log_p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (the chosen set, largest share first), shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = batch.column(1)
            shares, some, sure = infer(Words(texts), log_p)
            text = CodePoints(texts)
            known = some & (per_row(unicode().letter[text.points], text.offsets) > 0)
            pred, score, sets, parts = [], [], [], []
            for row, is_known, x in zip(shares, known, sure):
                order = [k for k in np.argsort(-row, kind="stable") if row[k] > 0] if is_known else []
                pred.append(names[order[0]] if order else "und")
                score.append(float(min(1.0, x)) if order else 0.0)
                sets.append([names[k] for k in order])
                parts.append([float(row[k]) for k in order])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                ["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages array<string>, shares array<double>")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    names, log_p = fit_languages(count_trigrams(docs.where(~held_out)).toPandas())
    return identify(docs, names, log_p).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
