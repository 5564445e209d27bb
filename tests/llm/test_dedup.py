"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, substring_dedup
from tests.llm.edge import documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def made_up(seed=1, n=120):
    """Texts of which some are copies, near copies, or share passages, with one hot passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
    text = lambda k: [word() for _ in range(k)]
    hot, base, out = text(70), [text(r.randint(1, 400)) for _ in range(n // 3)], []
    for i in range(n):
        kind, own = i % 6, list(r.choice(base))
        if kind == 1:
            for _ in range(max(1, len(own) // 60)):
                own[r.randrange(len(own))] = word()
        elif kind == 2:
            at = r.randrange(len(own) + 1)
            own = own[:at] + hot + own[at:]
        elif kind == 3:
            own = own[: len(own) // 2] + text(20) + own[len(own) // 2 :]
        elif kind == 4:
            own = text(r.randint(0, 200))
        elif kind == 5:
            own = ["same"] * r.randint(1, 200)
        out.append((i if i % 11 else i + 1, " ".join(own)))
    return out


def brute_windows(docs, size):
    """doc_id, text -> per row (n_words, n_removed, sha of kept words)."""
    least = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = Counter()
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < (float("inf") if i is None else i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def brute_classes(docs, threshold):
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("size", [50, 20, 7, 2, 1])
def test_windows(spark, size):
    docs = made_up()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeated_windows(frame, size, with_text=False).collect())
    assert got == brute_windows(docs, size)


@pytest.mark.parametrize("max_chunks", [0, 1, 3])
def test_windows_of_hot_fingerprints(spark, max_chunks):
    """Shards of any size, and the aggregation beyond max_chunks, remove the same."""
    docs = made_up(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeated_windows(frame, 20, with_text=False, max_chunks=max_chunks).collect())
    assert got == brute_windows(docs, 20)


def test_chunks_against_all_windows():
    """seen_before() on chunks that overlap in many ways."""
    r = random.Random(4)
    for _ in range(200):
        size = r.randint(1, 6)
        chunks = sorted((r.randint(0, 5), [r.choice("ab") for _ in range(r.randint(size, 14))]) for _ in range(12))
        want = []
        for low, own in chunks:
            before = {tuple(w[k : k + size]) for other, w in chunks if other < low for k in range(len(w) - size + 1)}
            want.append([k for k in range(len(own) - size + 1) if tuple(own[k : k + size]) in before])
        got = substring_dedup.seen_before([" ".join(w).encode() for _, w in chunks], [low for low, _ in chunks], size)
        assert got == want


def thue_morse(bits, zero, one):
    return [(zero, one)[bin(i).count("1") % 2] for i in range(1 << bits)]


def test_words_that_a_polynomial_modulo_a_power_of_two_confuses(spark):
    """Unlike words, windows and documents of Thue-Morse form stay unlike."""
    one, other = "".join(thue_morse(11, "a", "b")), "".join(thue_morse(11, "b", "a"))
    w = [f"w{i}" for i in range(61)]
    long_one, long_other = thue_morse(11, "a", "b"), thue_morse(11, "b", "a")
    docs = [(1, " ".join([*w[:20], one, *w[21:]])), (2, " ".join([*w[:20], other, *w[21:]])), (3, one), (4, other), (5, "x"), (6, " ".join(long_one)), (7, " ".join(long_other))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeated_windows(frame, with_text=False).collect())
    assert got == brute_windows(docs, 50)
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(frame).collect()}
    assert classes == brute_classes(docs, 0.8)


def test_hashes():
    """Ranges are equal wherever they lie, keys are independent, and residues are right."""
    import numpy as np

    from tessera.llm import words as w

    r = np.random.default_rng(0)
    values = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    values[200:260] = values[20:80]
    for key in (0, 1):
        a, b = w.range_hashes(values, np.array([20, 200, 21]), np.array([80, 260, 81]), key)[[0, 1]]
        assert a == b
    assert w.range_hashes(values, np.array([0]), np.array([9]), 0) != w.range_hashes(values, np.array([0]), np.array([9]), 1)
    p = int(w.PRIME)
    x, y = r.integers(0, p, 1000, dtype=np.uint64), r.integers(0, p, 1000, dtype=np.uint64)
    x[:3] = y[:3] = [0, 1, p - 1]
    assert w.product(x, y).tolist() == [int(i) * int(j) % p for i, j in zip(x, y)]
    up, down = w.powers(5000, 1)
    assert set(w.product(up, down).tolist()) == {1} and w.product(up[:-1], up[1]).tolist() == up[1:].tolist()


def test_windows_edge_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    out = substring_dedup.remove_repeated_windows(documents(spark)).collect()
    assert Counter(tuple(r)[:4] for r in out) == brute_windows(docs, 50)
    for r in out:
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        assert sum(b - a + 1 for a, b in r["spans"]) == r["n_removed"]
    assert substring_dedup.remove_repeated_windows(documents(spark, [])).count() == 0


def test_windows_of_one_id_that_differ_in_whitespace(spark):
    """Each row of a null or repeated id loses the passage that a smaller id holds."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(3, passage), *((i, text) for i in (None, 20) for text in (f"x{i} {passage}", f"x{i}  {passage}", f"\n x{i} {passage}\t", f"x{i} " + passage.replace(" ", "\r\n"), f"y{i} {passage}"))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = substring_dedup.remove_repeated_windows(frame).collect()
    assert Counter(tuple(r)[:4] for r in out) == brute_windows(docs, 50)
    assert sorted(r["kept"] for r in out if r["doc_id"] != 3) == ["x20"] * 4 + ["xNone"] * 4 + ["y20", "yNone"]
    assert sorted(r["text"] for r in substring_dedup.strip_repeats(frame).collect() if r["doc_id"] != 3) == ["x20"] * 4 + ["xNone"] * 4 + ["y20", "yNone"]
    more = [*((r[0], r[1]) for r in rows()), (None, "z " + passage), (None, "z\n" + passage), (12, "z " + passage), (12, "z\n" + passage)]
    out = substring_dedup.remove_repeated_windows(spark.createDataFrame(more, "doc_id long, text string"), with_text=False).collect()
    assert Counter(tuple(r) for r in out) == brute_windows(more, 50)


def test_strip_repeats_keeps_columns_and_clean_texts(spark):
    docs = documents(spark)
    out = substring_dedup.strip_repeats(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    clean = {(r[0], r[1]) for r in rows() if r[0] not in (7, 9) and not (r[0] is None and "p1" in r[1])}
    assert clean <= got
    assert {t for i, t in got if i == 7} == {"end"} and not any(i == 9 for i, _ in got)


def brute_statistics(reference, own):
    out = []
    for end in range(len(own)):
        n = 0
        while n <= end and any(own[end - n : end + 1] == ref[k : k + n + 1] for ref in reference for k in range(len(ref) - n)):
            n += 1
        out.append(n)
    return out


def test_suffix_automaton():
    r = random.Random(4)
    for _ in range(40):
        reference = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(3)]
        own = [r.choice("abc") for _ in range(20)]
        assert substring_dedup.SuffixAutomaton(reference).statistics(own) == brute_statistics(reference, own)


def test_reference_spans(spark):
    reference = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, "")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c"), (3, None), (4, "h g f e a b c d e f")], "doc_id int, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_reference_spans(docs, reference, 4, shards=2).collect()}
    assert out == {1: (6, 4, "x y"), 2: (3, 0, "a b c"), 3: (0, 0, ""), 4: (10, 6, "h g f e")}
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, reference, 4, max_bytes=3)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_classes(spark, threshold):
    docs = list({i: (i, t) for i, t in made_up(2, 240)}.values())
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicate_classes(frame, threshold).collect()}
    want = brute_classes(docs, threshold)
    if threshold == 0.8:  # the bands are laid out for this similarity
        assert {i: c for i, (c, _) in out.items()} == want
    sizes = Counter(c for c, _ in out.values())
    assert all(sizes[c] == n for c, n in out.values())
    assert all(want[i] == want[c] for i, (c, _) in out.items())


def test_weighted_similarity(spark):
    """Signatures agree as often as the weighted sets overlap."""
    import numpy as np

    r = np.random.default_rng(3)
    elements = r.integers(0, 1 << 63, 200).astype(np.uint64)
    weights = r.integers(1, 9, (2, 200)).astype(float)
    weights[1] = np.where(r.random(200) < 0.6, weights[0], weights[1])
    row = np.repeat([0, 1], 200)
    signed = near_dedup.signatures(row, np.tile(elements, 2), weights.ravel(), 2, size=4000)
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((signed[0] == signed[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4000)


def test_counted_shingles(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 3), (2, "a b c d e " * 3), (3, "a b c d e " * 30)], "doc_id long, text string")
    by_set = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs, weights="set").collect()}
    by_count = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(docs, weights="count").collect()}
    assert by_set == {1: 1, 2: 1, 3: 1} and by_count == {1: 1, 2: 1, 3: 3}


def test_mixed_bucket_links(spark):
    """A bucket's leader is unlike two members that are like each other."""
    links = spark.createDataFrame([(5, 3), (9, 5), (7, 8), (8, 2)], "a long, b long")
    assert {r["node"]: r["class_id"] for r in near_dedup.close(links).collect()} == {5: 3, 9: 3, 7: 2, 8: 2}


def test_classes_edge_rows(spark):
    docs = documents(spark)
    out = near_dedup.near_duplicate_classes(docs).collect()
    assert len(out) == docs.count()
    of = {r["doc_id"]: r["class_id"] for r in out}
    assert of[1] == of[4] == 1 and of[7] == 6 and of[2] == 2 and of[3] == 3 and of[10] == 10
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 6, 8, 10, 11, 12, None}
    assert near_dedup.near_duplicate_classes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda text: F.unhex(F.hex(F.length(text) % 3)), lambda text: F.lit(b"")])
def test_exact_groups(spark, keep, hashed):
    """Weak hashes collide; the groups stay right."""
    docs = documents(spark).select("doc_id", "text", "kept", "h")
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    key = (lambda i: -1 if i is None else i)
    out = exact_dedup.duplicate_groups(docs, keep, hashed=hashed).collect()
    assert len(out) == len(rows())
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = of[r["text_sha256"]]
        known = [i for i in ids if i is not None] or [None]
        assert r["group_size"] == len(ids) and r["keep_id"] == (max if keep == "max" else min)(known, key=key)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sorted(r["text_sha256"] for r in out if r["kept"]) == sorted(of)  # one row of each group


@pytest.mark.parametrize("keep", ["min", "max"])
def test_one_row_of_a_group_is_kept(spark, keep):
    """Of repeated rows one, of rows without id one, and a row with an id before one without."""
    docs = [(7, "a"), (7, "a"), (None, "b"), (None, "b"), (None, "c"), (5, "c"), (6, "c"), (None, None), (3, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = exact_dedup.duplicate_groups(frame, keep).collect()
    kept = {(r["doc_id"], r["text_sha256"]) for r in out if r["kept"]}
    assert len(out) == len(docs) and sum(r["kept"] for r in out) == len(kept) == 4
    whole = exact_dedup.exact_dedup(frame, keep).collect()
    assert kept == {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in whole}
    assert {i for i, _ in kept} == {7, None, 5 if keep == "min" else 6, 3}


@pytest.mark.parametrize("strip", [lambda d: substring_dedup.strip_repeats(d), lambda d: exact_dedup.exact_dedup(d), lambda d: near_dedup.drop_near_duplicates(d)])
def test_names_that_clash(spark, strip):
    names = ["gone_id", "gone_version", "gone_whole", "gone_windows", "content_hash", "content", "row_kept", "n_words", "buckets", "a.b"]
    docs = documents(spark).selectExpr("*", *(f"{k} AS `{n}`" for k, n in enumerate(names)))
    out = strip(docs)
    assert out.columns == docs.columns and 0 < out.count() <= len(rows())


def test_exact_dedup_keeps_one_whole_row(spark):
    docs = documents(spark)
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    got = sorted((r["text"] or "", -1 if r["doc_id"] is None else r["doc_id"]) for r in out.collect())
    want = {}
    for r in rows():
        want.setdefault(r[1] or "", []).append(r[0])
    assert [t for t, _ in got] == sorted(want)
    assert dict(got)["the cat sat on the mat with a hat and a bat"] == 1
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    assert exact_dedup.duplicate_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("weights", ["set", "count"])
def test_links_to_main_in_small_blocks(spark, weights):
    """Every class that a minor is linked to is found, whatever the blocks."""
    import numpy as np

    from tessera.llm.near_dedup import jaccard, links_to_main

    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 20, 40)
    kind = np.uint32 if weights == "set" else np.uint64
    sets = {}
    for i in range(30):
        own = np.where(r.random(40) < 0.15, r.integers(0, 1 << 20, 40), base)
        sets[i] = np.unique(own).astype(np.uint32).tobytes() if weights == "set" else np.unique(own.astype(np.uint64) << np.uint64(24) | np.uint64(1)).astype(kind).tobytes()
    classes = {i: 0 if i < 20 else i // 3 * 3 for i in sets}
    row = lambda i: (0, i, classes[i])
    schema = "main long, doc_id long, class_id long"
    minors = spark.createDataFrame([row(i) for i in sets if classes[i]], schema)
    members = spark.createDataFrame([row(i) for i in sets], schema)
    blobs = spark.createDataFrame([(i, bytearray(b)) for i, b in sets.items()], "doc_id long, shingles binary")
    out = [tuple(x) for x in links_to_main(minors, members, blobs, weights, 0.7, block=4).collect()]
    assert all(jaccard(sets[a], sets[b], weights) >= 0.7 and classes[a] != classes[b] for a, b in out)
    got = {(a, classes[b]) for a, b in out}
    assert got == {(a, classes[b]) for a in sets for b in sets if classes[a] and classes[a] != classes[b] and jaccard(sets[a], sets[b], weights) >= 0.7}
