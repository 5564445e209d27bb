"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1, a sample of at most about max_rows by a hash of
the id; labels of quality 0 are never used. Unlabelled text is every row given, whole. An additive
model over bins of dense text features (their quantiles over all rows) minimises the non-negative
unbiased risk with logistic loss l,
    prior mean_p l(f) + max(0, mean_u l(-f) - prior mean_p l(-f)),
by limited-memory quasi-Newton steps; each step sums the unlabelled part of value and gradient over
all rows in Spark, from a table of 18 bin numbers a row.

Positives and unlabelled rows are dealt into two halves, and each has a model. What a model gives to
the positives of the other half, against what it gives to its unlabelled rows, tells two things:
  - the class prior: where no negatives score, the unlabelled share above a margin is prior times
    that of the positives; the prior is the least ratio of the two, within its error. The models are fitted for a
    prior of 1/2 first, and again for the one found;
  - the probability: prior times the positives' density over the unlabelled one, by bands of the
    margin, made monotone by isotonic regression. The score is the mean of both models'.

Defined results: null and empty texts have all-zero features and get a score like any other;
where a half lacks positives or unlabelled rows, every score is 1; a repeated label counts once,
by its maximum; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, stored, table
from tessera.llm.features import LETTER, PUNCTUATION, per_row, shares
from tessera.llm.words import Words, run_hashes, slices


def repeats(row: np.ndarray, hashes: np.ndarray, weights: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: weight of items seen before in the row, and weight of its most frequent item."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    again = np.bincount(r, np.where(new, 0.0, weights[order]), rows)
    most = np.zeros(rows)
    if len(starts):
        np.maximum.at(most, r[starts], np.add.reduceat(weights[order], starts))
    return again, most


def quality_features(texts: pa.Array) -> np.ndarray:
    """One row of features per text; all zero for an empty one."""
    words = Words(texts)
    raw, offsets = words.raw, words.offsets
    size = (words.end - words.start).astype(float)
    n = np.maximum(1, np.diff(words.first)).astype(float)
    size_sum = np.maximum(1, per_row(size, words.first))
    hashes = words.hashes()
    again, most = repeats(words.row, hashes, np.ones(len(hashes)), words.rows)
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    marks = np.concatenate([[0], np.cumsum(PUNCTUATION[raw])])
    letters = np.concatenate([[0], np.cumsum(LETTER[raw])])
    symbols = (marks[words.end] - marks[words.start]) >= 2
    no_letter = letters[words.end] == letters[words.start]
    feed = np.flatnonzero(raw == 10)
    cuts = np.union1d(offsets, feed + 1)
    starts, ends = cuts[:-1], cuts[1:]
    line_row = np.searchsorted(offsets, starts, side="right") - 1
    lines_again, _ = repeats(line_row, run_hashes(raw, starts, ends), (ends - starts).astype(float), words.rows)
    length = np.maximum(1, np.diff(offsets)).astype(float)
    columns = [
        np.log1p(np.diff(words.first)),
        size_sum / n,
        again / n,
        most / n,
        per_row(same, words.first) / n,
        per_row(symbols, words.first) / n,
        per_row(no_letter, words.first) / n,
        lines_again / length,
        np.bincount(line_row, minlength=words.rows) / n,
    ]
    matrix = np.concatenate([np.stack(columns, 1), shares(words)], 1)
    matrix[np.diff(offsets) == 0] = 0
    return matrix


FEATURES, BINS, BANDS = 18, 24, 120


@dataclass
class Half:
    """One additive model and its probabilities by bands of the margin."""

    weights: np.ndarray
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.ones(1))

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(1) + self.weights[-1]

    def counts(self, bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Rows in each band of the margin."""
        return np.bincount(np.searchsorted(cuts, self.margin(bins)), minlength=len(cuts) + 1)

    def score(self, bins: np.ndarray) -> np.ndarray:
        """Levels, in which the margin itself parts what would be equal."""
        margin = self.margin(bins)
        return 0.999 * self.levels[np.searchsorted(self.cuts, margin)] + 0.001 * sigmoid(margin)


@dataclass
class QualityModel:
    edges: list[np.ndarray] = field(default_factory=list)
    halves: list[Half] = field(default_factory=list)
    prior: float = 1.0

    def score(self, matrix: np.ndarray) -> np.ndarray:
        if not self.halves:
            return np.full(len(matrix), self.prior)
        bins = binned(matrix, self.edges)
        return np.mean([half.score(bins) for half in self.halves], 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each row and feature the number of its bin among the bins of all features."""
    return np.stack([np.searchsorted(e, matrix[:, k]) + (BINS * k) for k, e in enumerate(edges)], 1)


def sums_of(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Of unlabelled rows: the sum of l(-f), and its gradient."""
    f = weights[bins].sum(1) + weights[-1]
    slope = sigmoid(f)
    return np.concatenate([[softplus(f).sum()], np.bincount(bins.ravel(), np.repeat(slope, bins.shape[1]), BINS * bins.shape[1]), [slope.sum()]])


def risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and its gradient; unlabelled: means of sums_of()."""
    f = weights[positive].sum(1) + weights[-1]
    grow = lambda r: np.append(np.bincount(positive.ravel(), np.repeat(r, positive.shape[1]), len(weights) - 1), r.sum()) / len(f)
    value, gradient = prior * softplus(-f).mean(), -prior * grow(sigmoid(-f))
    negative = unlabelled[0] - prior * softplus(f).mean()
    if negative > 0:
        value, gradient = value + negative, gradient + unlabelled[1:] - prior * grow(sigmoid(f))
    shrunk = np.append(weights[:-1], 0)
    return value + ridge / 2 * (shrunk @ shrunk), gradient + ridge * shrunk


def quasi_newton(weights: np.ndarray, steps: int, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields weights, is sent their value and gradient, and returns the last ones that improved."""
    value, gradient = yield weights
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = gradient.copy(), []
        for s, y in reversed(pairs):
            parts.append(s @ way / (y @ s))
            way -= parts[-1] * y
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.linalg.norm(gradient))
        for (s, y), part in zip(pairs, reversed(parts)):
            way += (part - y @ way / (y @ s)) * s
        for halvings in range(8):
            step = weights - way / 2**halvings
            new_value, new_gradient = yield step
            if new_value <= value - 1e-4 * (gradient @ way) / 2**halvings:
                break
        else:
            return weights
        if (step - weights) @ (new_gradient - gradient) > 1e-12:
            pairs = [*pairs, (step - weights, new_gradient - gradient)][-memory:]
        enough = value - new_value < 1e-6 * abs(value)
        weights, value, gradient = step, new_value, new_gradient
        if enough:
            break
    return weights


#: For the weights of each half: means of sums_of() over its unlabelled rows.
Unlabelled = Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]]
#: For weights and cuts of each half: unlabelled rows of the other half by bands of the margin.
Margins = Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def minimise(positives: list[np.ndarray], unlabelled: Unlabelled, prior: float, ridge: float, steps: int) -> list[np.ndarray]:
    """The weights of least risk for each half, from zero; both take their steps together, so that
    each call of unlabelled() serves both."""
    start = np.zeros(BINS * positives[0].shape[1] + 1)
    found = [start] * len(positives)
    running = {k: quasi_newton(start, steps) for k in range(len(positives))}
    asked = {k: next(r) for k, r in running.items()}
    while asked:
        means, following = unlabelled(asked), {}
        for k, weights in asked.items():
            try:
                following[k] = running[k].send(risk(weights, positives[k], means[k], prior, ridge))
            except StopIteration as done:
                found[k] = done.value
        asked = following
    return found


def class_prior(positive: np.ndarray, counts: np.ndarray, cuts: np.ndarray, errors: float = 4.0) -> float:
    """The ratio of the unlabelled to the positive share above the margin at which it is least when
    so many standard errors are added to it. counts: of unlabelled margins, by bands of the cuts."""
    share = (positive[:, None] > cuts).mean(0)
    above = (counts.sum() - np.cumsum(counts)[:-1]) / counts.sum()
    some = (share > 0) & (above > 0)
    if not some.any():
        return 1.0
    share, above = share[some], above[some]
    error = np.sqrt((1 - above) / (above * counts.sum()) + (1 - share) / (share * len(positive)))
    ratio = above / share
    return float(np.clip(ratio[np.argmin(ratio * (1 + errors * error))], 0.01, 1.0))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values, by pooling neighbours."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, x, n), (b, y, m) = blocks[-2:]
            blocks[-2:] = [[(a * x + b * y) / (x + y), x + y, n + m]]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibrated(half: Half, other: np.ndarray, counts: np.ndarray, cuts: np.ndarray, prior: float) -> Half:
    """half with its probabilities: prior times the density of other (bins of the positives that it
    was not fitted to) over that of the unlabelled rows, whose margins fall into bands as counted."""
    some = counts > 0
    density = half.counts(other, cuts) / len(other)
    ratio = prior * density[some] / (counts[some] / counts.sum())
    levels = np.interp(np.arange(len(counts)), np.flatnonzero(some), np.clip(isotonic(ratio, counts[some].astype(float)), 0, 1))
    return Half(half.weights, cuts, levels)


def fit_quality(positives: list[np.ndarray], unlabelled: Unlabelled, margins: Margins, ridge: float = 1e-3, steps: tuple[int, int] = (20, 40)) -> tuple[list[Half], float]:
    """A model for each half, and the class prior. positives: bins of each half's."""
    weights = minimise(positives, unlabelled, 0.5, ridge, steps[0])

    def counted(weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cuts into bands of about equal counts of unlabelled margins, and those counts."""
        reach = [np.abs(w[:-1].reshape(-1, BINS)).max(1).sum() for w in weights]
        fine = [w[-1] + np.linspace(-r, r, 4096) for w, r in zip(weights, reach)]
        out = []
        for cuts, counts in zip(fine, margins(weights, fine)):
            ends = np.searchsorted(np.cumsum(counts), counts.sum() * np.arange(1, BANDS) / BANDS)
            ends = np.unique(np.minimum(ends, len(cuts) - 1))
            out.append((cuts[ends], np.diff(np.cumsum(counts)[np.append(ends, len(counts) - 1)], prepend=0)))
        return out

    others = positives[::-1]
    prior = float(np.mean([class_prior(Half(w).margin(o), counts, cuts) for w, o, (cuts, counts) in zip(weights, others, counted(weights))]))
    weights = minimise(positives, unlabelled, prior, ridge, steps[1])
    return [calibrated(Half(w), o, counts, cuts, prior) for w, o, (cuts, counts) in zip(weights, others, counted(weights))], prior


def features_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, f1, ...: the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            matrix = quality_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, matrix.T)], ["doc_id", *(f"f{k}" for k in range(FEATURES))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"f{k} double" for k in range(FEATURES)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f"f{k}")) for k in range(FEATURES)], 1)


def fit(features: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> QualityModel:
    """The model from features_of() all unlabelled rows and labels (doc_id, quality), both of
    training rows only. features is read once for the quantiles and once for the bins."""
    known = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    part = int(min(1.0, max_rows / max(1, known.count())) * 1_000_000)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)).cast("double").alias("half")
    columns = [half, *(f"f{k}" for k in range(FEATURES))]
    positive = features.join(F.broadcast(chosen), "doc_id").select(columns).toPandas().to_numpy()  # max_rows bounds both
    marks = [k / BINS for k in range(1, BINS)]
    found = features.select(columns).agg(F.count(F.lit(1)), F.coalesce(F.sum("half"), F.lit(0.0)), *[F.percentile_approx(f"f{k}", marks, 2000) for k in range(FEATURES)]).first()
    sizes = [found[0] - found[1], found[1]]
    if not all(sizes) or len(set(positive[:, 0])) < 2:
        return QualityModel()
    edges = [np.unique(np.array(x)) for x in found[2:]]
    bins = stored(_bins(features.select(columns), edges))

    def summed(each: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        """The sum of each(bins of both halves) over all rows; every task sends one vector."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(batch.num_rows, FEATURES + 1)
                part = each([rows[rows[:, 0] == k, 1:] for k in (0, 1)])
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

        return np.sum([r["sums"] for r in bins.mapInArrow(run, "sums array<double>").collect()], 0)

    def unlabelled(weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        sums = summed(lambda rows: np.concatenate([sums_of(w, rows[k]) for k, w in weights.items()]))
        return {k: x / sizes[k] for k, x in zip(weights, np.split(sums, len(weights)))}

    def margins(weights: list[np.ndarray], cuts: list[np.ndarray]) -> list[np.ndarray]:
        counts = lambda rows: [Half(w).counts(rows[1 - k], c) for k, (w, c) in enumerate(zip(weights, cuts))]
        return np.split(summed(lambda rows: np.concatenate(counts(rows)).astype(float)), 2)

    positives = [binned(positive[positive[:, 0] == k, 1:], edges) for k in (0, 1)]
    return QualityModel(edges, *fit_quality(positives, unlabelled, margins))


def _bins(columns: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """The half and the bins of every row, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([np.asarray(batch.column("half"))[:, None], binned(_matrix(batch), edges)], 1).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["bins"])

    return columns.mapInArrow(run, "bins binary")


def score_features(features: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1) of every row of features_of()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], ["doc_id", "score"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text scores at least `least`."""
    plain = [f"c{k}" for k in range(len(docs.columns))]  # no name that needs quotes reaches the workers
    text = plain[docs.columns.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            yield batch.filter(pa.array(model.score(quality_features(batch.column(text))) >= least))

    rows = docs.toDF(*plain)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    features = stored(features_of(docs))
    scored = score_features(features, fit(features.where(~held_out), labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
