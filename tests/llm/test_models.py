"""Held-out accuracy of the fitted operators, and their results for odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import features, language, quality, toxicity
from tests.llm.edge import documents, rows


def held_out_truth(spark, folder, frame, column):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", column)
    return frame.where("held_out").join(labels, "doc_id").toPandas()


def test_language_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    out = language.op3_language(spark, medium)
    both = out.where("held_out").join(docs, "doc_id").toPandas()
    assert len(both) > 100 and (both.lang_pred == both.lang).mean() > 0.97
    assert both.score.between(0, 1).all() and out.count() == docs.count()


def test_language_mixture(spark):
    """Half the words from one language, half from another: both are found, at about half each."""
    first = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    second = ["schiff", "wasser", "brücke", "straße", "mädchen", "jahr"]
    training = spark.createDataFrame([("x", " ".join(first * 50)), ("y", " ".join(second * 50)), (None, "zzz"), ("x", None)], "lang string, text string")
    names, log_p = language.fit_languages(language.count_trigrams(training).toPandas())
    assert names == ["x", "y"]
    mixed = " ".join(a + " " + b for a, b in zip(first * 20, second * 20))
    docs = spark.createDataFrame([(1, mixed), (2, " ".join(first)), (3, None), (4, ""), (5, "12 %% 34"), (6, "😀 ½ ² Ⅷ")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language.identify(docs, names, log_p).collect()}
    assert set(out[1]["languages"]) == {"x", "y"} and abs(out[1]["shares"][0] - 0.5) < 0.1
    assert out[2]["lang_pred"] == "x" and out[2]["languages"] == ["x"] and 0.9 < out[2]["score"] <= 1.0
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5, 6))


def test_language_agrees_with_plain_em():
    """maximise() against EM written out word by word."""
    r = np.random.default_rng(1)
    likelihood = r.random((30, 3))
    shares = np.full(3, 1 / 3)
    for _ in range(5):
        joint = likelihood * shares
        shares = (joint / joint.sum(1, keepdims=True)).mean(0)
    got, value = language.maximise(likelihood, np.zeros(30, int), np.array([0, 30]), np.full((1, 3), 1 / 3), 5)
    assert np.allclose(got[0], shares) and np.isclose(value[0], np.log((likelihood * shares).sum(1)).sum())


def test_language_sets_against_brute_force(spark):
    """Texts of one to five languages: set and shares as by the best of all sets, each by long EM."""
    from itertools import combinations

    r = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = {f"l{k}": ["".join(r.choice(letters[5 * k : 5 * k + 8] if k < 4 else letters[18:], 6)) for _ in range(40)] for k in range(5)}
    training = spark.createDataFrame([(k, " ".join(v * 20)) for k, v in vocabulary.items()], "lang string, text string")
    names, log_p = language.fit_languages(language.count_trigrams(training).toPandas())
    assert names == list(vocabulary)
    texts = [" ".join(w for k in range(size) for w in r.choice(vocabulary[f"l{(k + size) % 5}"], 25)) for size in range(1, 6)]
    texts.append(" ".join(w for k, many in enumerate((60, 25, 12, 8)) for w in r.choice(vocabulary[f"l{k}"], many)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x for x in language.identify(docs, names, log_p).collect()}
    for k, text in enumerate(texts):
        words = text.split()
        scores = np.array([log_p[:, language.trigram_buckets(np.frombuffer(f" {w} ".encode(), np.uint8))[1:-1]].sum(1, dtype=float) for w in words])
        best = (-np.inf, ())
        for size in range(1, 6):
            for chosen in combinations(range(5), size):
                likelihood = np.exp(scores[:, chosen] - scores[:, chosen].max(1, keepdims=True))
                shares = np.full(size, 1 / size)
                for _ in range(3000):
                    joint = likelihood * shares
                    shares = (joint / joint.sum(1, keepdims=True)).mean(0)
                value = np.log((likelihood * shares).sum(1)).sum() + scores[:, chosen].max(1).sum() - (size - 1) * np.log(len(words)) / 2
                best = max(best, (value, chosen, tuple(shares)))
        want = {names[c]: s for c, s in zip(best[1], best[2])}
        got = dict(zip(out[k]["languages"], out[k]["shares"]))
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-4 for x in want)
        assert abs(out[k]["score"] - max(got.values())) < 0.05
    assert [len(out[k]["languages"]) for k in range(6)] == [1, 2, 3, 4, 5, 4] and out[3]["score"] < 0.3


def test_language_score_of_words_that_tell_little(spark):
    """A word that both languages hold leaves it open which it is; and odd rows meet a fitted model."""
    training = spark.createDataFrame([("x", "same alpha " * 50), ("y", "same wasser " * 50)], "lang string, text string")
    names, log_p = language.fit_languages(language.count_trigrams(training).toPandas())
    docs = spark.createDataFrame([(1, "same"), (2, "alpha alpha alpha")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language.identify(docs, names, log_p).collect()}
    assert score[1] < 0.9 < score[2] <= 1
    out = language.identify(documents(spark), names, log_p).collect()
    assert len(out) == len(rows()) and all((r["lang_pred"] == "und") == (r["score"] == 0) and 0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in out if r["lang_pred"] == "und"} == {2, 3, 5, 12} - {12} | {r[0] for r in rows() if r[1] == "1234 5678"}


def test_no_language_learned(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    names, log_p = language.fit_languages(language.count_trigrams(empty).toPandas())
    out = language.identify(documents(spark), names, log_p).collect()
    assert len(out) == len(rows()) and {r["lang_pred"] for r in out} == {"und"}
    assert language.identify(documents(spark, []), names, log_p).count() == 0


def test_toxicity_accuracy(spark, medium):
    out = toxicity.op6_toxicity(spark, medium)
    both = held_out_truth(spark, medium, out, "toxic")
    bad = both.toxic == 1
    assert both.score.between(0, 1).all()
    assert both.predicted[~bad].mean() < 0.05 and both.score[bad].mean() > both.score[~bad].mean() + 0.3
    assert out.count() == spark.read.parquet(f"{medium}/documents.parquet").count()


def test_toxicity_features():
    """Hits, closeness to second persons, and look-alike spellings."""
    lexicon = np.array([features.word_hash("moron")], np.uint64)
    person = np.array([features.word_hash("you")], np.uint64)
    none = np.zeros(0, np.uint64)
    texts = pa.array(["you are a moron", "a moron said that all of them should leave, you", "a m0r0n", "clean words", "", None, "MORON!!"])
    m = toxicity.feature_matrix(texts, lexicon, np.array([2.0]), none, person)
    assert m[:, 0].tolist() == [1, 1, 0, 0, 0, 0, 1]
    assert m[0, 5] == 1 and m[1, 5] == 0
    assert m[2, 7] == 1 and m[0, 7] == 0
    assert not m[4].any() and not m[5].any()


def test_letters_of_any_script():
    """Curly quotes, dashes and capitals outside ASCII cut and fold as in learning."""
    of = lambda text, **kind: features.LetterWords(features.CodePoints(pa.array([text])), **kind).hash.tolist()
    assert of("“idiot” you’re ÉTAIT—fool, ½ 漢字") == [features.word_hash(w) for w in ("idiot", "you", "re", "était", "fool", "漢字")]
    assert of("1d10t ìdíot ｉｄｉｏｔ іdіоt 123", lookalike=True) == [features.word_hash("idiot")] * 4


def test_toxicity_of_a_fitted_model(spark):
    """Trees learned from made-up rows find new ones, calmly meet odd rows, and scores rise with hits."""
    r = np.random.default_rng(5)
    plain = [f"word{i}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(200)]
    text = lambda bad: " ".join(np.where(r.random(40) < (0.15 if bad else 0), "“grumblefoo”", r.choice(plain, 40)))
    known = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    new = [(1000 + i, text(i % 2 == 0)) for i in range(100)]
    odd = [(2000 + (k if i is None else i), t) for k, (i, t, *_) in enumerate(rows())]
    docs = spark.createDataFrame([*((i, t, "x") for i, t, _ in known), *((i, t, None) for i, t in new + odd), (None, None, None)], "doc_id long, text string, margin string")
    labels = spark.createDataFrame([*((i, y) for i, _, y in known), (3, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, labels).toPandas()
    assert len(out) == len(known) + len(new) + len(odd) + 1 and out.score.between(0, 1).all()
    score = out.dropna().set_index("doc_id").score
    assert all((score[1000 + i] >= 0.5) == (i % 2 == 0) for i in range(100) if "grumblefoo" in new[i][1] or i % 2)
    assert (score[[i for i, _ in odd]] < 0.5).all()


def test_toxicity_odd_rows(spark):
    docs = documents(spark)
    one_class = spark.createDataFrame([(1, 0), (8, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, one_class).collect()
    assert len(out) == len(rows()) and {r["score"] for r in out} == {0.0}
    assert toxicity.score_toxicity(docs, one_class.limit(0)).count() == len(rows())
    assert toxicity.score_toxicity(documents(spark, []), one_class).count() == 0


def test_quality_accuracy(spark, medium):
    out = quality.op10_quality(spark, medium)
    both = held_out_truth(spark, medium, out, "quality")
    good = both.quality == 1
    assert both.score.between(0, 1).all() and both.predicted[good].mean() > 0.9
    assert both.score[good].mean() > both.score[~good].mean() + 0.3


def two_groups(r, good, bad):
    """Rows of 18 features, of which the first tells good from bad."""
    rows = r.normal(0, 1, (good + bad, quality.FEATURES))
    rows[:, 0] += np.repeat([2, -2], [good, bad])
    return rows


def in_memory(halves):
    """The unlabelled sums and margins of fit_quality(), over arrays."""

    def margins(weights, cuts):
        return [quality.Half(w).counts(halves[1 - k], c) for k, (w, c) in enumerate(zip(weights, cuts))]

    return lambda weights: {k: quality.sums_of(w, halves[k]) / len(halves[k]) for k, w in weights.items()}, margins


def test_non_negative_risk():
    """The prior is found, and the classes of two Gaussians are told apart, without any negative."""
    r = np.random.default_rng(0)
    unlabelled, positive = two_groups(r, 14000, 6000), two_groups(r, 6000, 0)
    edges = [np.unique(np.quantile(x, np.arange(1, quality.BINS) / quality.BINS)) for x in unlabelled.T]
    of = lambda rows: [quality.binned(rows[k::2], edges) for k in (0, 1)]
    halves, prior = quality.fit_quality(of(positive), *in_memory(of(unlabelled)))
    model = quality.QualityModel(edges, halves, prior)
    good, bad = model.score(two_groups(r, 500, 0)), model.score(two_groups(r, 0, 500))
    assert abs(prior - 0.7) < 0.06
    assert good.mean() > bad.mean() + 0.5 and (good >= 0.5).mean() > 0.9 and (bad < 0.5).mean() > 0.9


def test_risk_gradient():
    """Against finite differences, on both sides of the bound at zero."""
    r = np.random.default_rng(1)
    bins = lambda n: r.integers(0, quality.BINS, (n, quality.FEATURES)) + quality.BINS * np.arange(quality.FEATURES)
    positive, unlabelled = bins(50), bins(80)
    for scale, prior in ((0.1, 0.5), (3.0, 0.95)):
        w = r.normal(0, scale, quality.BINS * quality.FEATURES + 1)
        at = lambda w: quality.risk(w, positive, quality.sums_of(w, unlabelled) / 80, prior, 0.01)  # noqa: E731, B023
        value, gradient = at(w)
        for k in (0, 30, 400, len(w) - 1):
            e = np.zeros_like(w)
            e[k] = 1e-5
            assert abs((at(w + e)[0] - at(w - e)[0]) / 2e-5 - gradient[k]) < 1e-5


def test_fit_sums_over_all_rows(spark):
    """The model from tables in many partitions equals that from arrays."""
    r = np.random.default_rng(2)
    rows = two_groups(r, 300, 100)
    names = [f"f{k}" for k in range(quality.FEATURES)]
    frame = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "doc_id long, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)], "doc_id long, quality int")
    model = quality.fit(frame, labels)
    exact = frame.selectExpr("*", "pmod(xxhash64(5, doc_id), 2L) AS half").toPandas().sort_values("doc_id")
    of = lambda some: [quality.binned(some[some.half == k][names].to_numpy(), model.edges) for k in (0, 1)]
    halves, prior = quality.fit_quality(of(exact[(exact.doc_id < 300) & (exact.doc_id % 2 == 0)]), *in_memory(of(exact)))
    want = quality.QualityModel(model.edges, halves, prior).score(exact[names].to_numpy())
    got = quality.score_features(frame, model).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.isclose(model.prior, prior) and np.allclose(got, want, atol=1e-6)


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3, 2, 2, 5, 4]), np.ones(6)).tolist() == [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5]


def test_quality_features():
    texts = pa.array(["a b c d", "w w w w", "line\nline\nline\n", "", None, "x*** y%%% z&&&"])
    m = quality.quality_features(texts)
    assert m[1, 3] == 1 and m[0, 3] == 0.25 and m[1, 4] == 0.75
    assert m[2, 7] > 0.6 and m[5, 5] == 1
    assert not m[3].any() and not m[4].any()


def test_quality_odd_rows(spark):
    docs = documents(spark)
    features = quality.features_of(docs)
    for labels in ([], [(1, 0), (8, 0)], [(1, 1), (2, None), (None, 1)]):  # no two positives
        model = quality.fit(features, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["score"] for r in quality.score_features(features, model).collect()} == {1.0}
    labels = spark.createDataFrame([(i, 1) for i in (1, 4, 8, 8, 10, None)] + [(2, 0), (6, None)], "doc_id long, quality int")
    model = quality.fit(features, labels)
    assert model.halves
    out = quality.score_features(features, model).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    kept = quality.keep_quality(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    nothing = quality.features_of(documents(spark, []))
    assert quality.score_features(nothing, model).count() == 0 and not quality.fit(nothing, labels).halves


@pytest.mark.parametrize("texts", [["One two", None, "", "trois", "4 five"], [], [None], ["", ""]])
def test_letter_words(texts):
    words = features.LetterWords(features.CodePoints(pa.array(texts, pa.string())))
    assert np.diff(words.first).tolist() == [len([w for w in (t or "").split() if any(c.isalpha() for c in w)]) for t in texts]


def test_folds(spark):
    import zlib

    from tessera.llm.common import fold

    ids = [0, 1, -5, 12345678901, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold("doc_id", 4)).collect()]
    assert got == [zlib.crc32(("" if i is None else str(i)).encode()) % 4 for i in ids]
