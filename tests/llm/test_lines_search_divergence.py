"""Line dedup, ranked search and divergence against brute force, on odd rows and on bounds that bind."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, line_dedup, ranked_search, terms
from tests.llm import edge

BLANK = " \t\n\x0b\x0c\r"
REPEATED = "A line that many documents HOLD"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def line_rows():
    more = [
        (20, f"{REPEATED}\nfirst own line of the text"),
        (21, f"\n  {REPEATED.upper()}\t\nfirst\n\n"),
        (22, f"{REPEATED}\n{REPEATED}\nlast"),
        (22, f"{REPEATED} \nof one id"),
        (23, "x\n" + REPEATED),
        (None, REPEATED + "\nkept"),
        (None, REPEATED),
        (24, "ÄÖÜ" * 7 + "\nshort\nÄÖÜ"),
        (25, "ÄÖÜ" * 7),
        (26, "ÄÖÜ" * 7 + "\n"),
        (27, "äöü" * 7),
        (28, "nineteen characters"),
        (29, "nineteen characters"),
        (30, "nineteen characters"),
        (31, "only two documents hold it"),
        (32, "only two documents hold it"),
    ]
    rows = edge.rows()
    return rows + [(i, t, *rows[0][2:]) for i, t in more]


def brute_lines(rows, least=20, documents=3):
    key = lambda line: lower(line.strip(BLANK))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    keeper = {k: max(-1 if i is None else i for i in ids) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


@pytest.mark.parametrize("max_bits", [line_dedup.MAX_BITS, 1])
def test_lines_against_brute_force(spark, max_bits, monkeypatch):
    monkeypatch.setattr(line_dedup, "GATHERED", 3)
    docs = edge.documents(spark, line_rows()).repartition(3)
    got = [tuple(r) for r in line_dedup.without_repeats(docs, max_bits=max_bits).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines([r[:2] for r in line_rows()]), key=repr)


def test_lines_of_random_texts(spark):
    draw = random.Random(5)
    pool = [" " * draw.randrange(3) + draw.choice(["Aé", "b", "😀"]) * draw.randrange(30) for _ in range(12)]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(5)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.without_repeats(docs, 4, 2).collect()]
    assert sorted(got) == sorted(brute_lines(rows, 4, 2))


def test_full_filter_only_adds_suspects(spark, monkeypatch):
    """A filter with all bits set keeps all results; every line is a suspect then."""
    rows = [(i, f"line number {i} of this file\n{REPEATED}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    look = line_dedup.Suspects(b"\xff" * 16, 20)
    assert all(len(list(look.of(t.encode()))) == 2 for _, t in rows)
    seen = line_dedup.twice_seen(docs, 20, line_dedup.SEGMENT_BITS).value
    found = [[k for *_, k in line_dedup.Suspects(seen, 20).of(t.encode())] for _, t in rows]
    assert all(lower(REPEATED).encode() in keys for keys in found)
    assert sum(len(keys) for keys in found) < 44


def test_empty_line_table(spark):
    assert line_dedup.without_repeats(edge.documents(spark, [])).count() == 0


TERM12, TERM13 = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def test_term_lists(monkeypatch):
    monkeypatch.setattr(terms, "CUT_BYTES", 7)
    draw = random.Random(1)
    texts = ["", " ", "aB1-Z", "x" * 50, "é" * 20 + " 漢字,a_b", *("".join(draw.choice("aZ09 _@[`{\x7f\x00é漢😀\n-") for _ in range(draw.randrange(60))) for _ in range(300))]
    for text in texts:
        for table, pattern in ((ranked_search.TERM_BYTES, TERM12), (divergence.TERM_BYTES, TERM13)):
            got = [t.decode() for part in terms.term_lists(text.encode(), table) for t in part]
            assert got == [lower(t) for t in pattern.findall(text)]


def test_packed_integers():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**63, 2**64 - 1], np.uint64)
    assert (terms.unpacked(terms.packed(values)) == values).all()
    assert terms.packed(values[:3]) == b"\x00\x01\x7f" and len(terms.unpacked(b"")) == 0


def brute_search(rows, queries, k):
    docs = [(i, Counter(lower(t) for t in TERM12.findall(text or ""))) for i, text in rows]
    docs = [(i, c) for i, c in docs if c]
    n, size = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        asked = Counter(lower(t) for t in TERM12.findall(text or ""))
        scores = []
        for i, c in docs:
            m = 75 + 25 * c.total() * n // size
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k])]
    return out


QUERIES = [(1, "the cat and a HAT"), (2, "p3 p4 p4 word7 word9"), (2, "word"), (3, None), (4, "... --"), (5, "漢字 zoë 1234"), (1, "the cat and a HAT"), (None, "text without id"), (6, "absent")]


@pytest.mark.parametrize("block, asked, shard", [(100_000, 200_000, 8192), (3, 200_000, 3), (100_000, 1, 2)])
def test_search_against_brute_force(spark, block, asked, shard, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCUMENTS", shard)
    docs = edge.documents(spark).repartition(3)
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = [tuple(r) for r in ranked_search.search(docs, queries, 5, block_terms=block, max_asked=asked).collect()]
    assert sorted(got, key=repr) == sorted(brute_search([r[:2] for r in edge.rows()], QUERIES, 5), key=repr)


def test_search_of_random_texts(spark):
    """Many ties and few terms, so that lists leave the merge at the worst kept score."""
    draw = random.Random(11)
    word = lambda: f"w{int(draw.paretovariate(0.7)) % 40}"
    rows = [(i * 7 % 501, " ".join(word() for _ in range(draw.randrange(12)))) for i in range(500)]
    queries = [(q, " ".join(word() for _ in range(6))) for q in range(12)]
    got = ranked_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(queries, "item_id long, text string"), 7)
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(rows, queries, 7))


def test_search_of_empty_tables(spark):
    none, queries = edge.documents(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, queries).collect() == []
    assert ranked_search.search(edge.documents(spark), queries.limit(0)).collect() == []


def brute_divergence(rows, least, top):
    groups = defaultdict(Counter)
    df = defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(lower(t) for t in TERM13.findall(text or ""))
        groups[lang or "", source or ""].update(found)
        df[lang or ""].update(found.keys())
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        of = {s: c for (g, s), c in groups.items() if g == lang}
        whole = sum(of.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v)

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in of.items():
            pairs = [(-sum(f(share(c, t), share(d, t)) for t in kept), r) for r, d in of.items() if r != s]
            marked = [(-f(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            out += [(lang, s, "pair", r, -x, i + 1) for i, (x, r) in enumerate(sorted(pairs, key=lambda z: (z[0], z[1].encode())))]
            out += [(lang, s, "term", t, -x, i + 1) for i, (x, t) in enumerate(sorted(marked, key=lambda z: (z[0], z[1].encode()))[:top])]
    return out


@pytest.mark.parametrize("held", [divergence.HELD, 2])
def test_divergence_against_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    draw = random.Random(2)
    rows = [(" ".join(draw.choice(["a", "B", "é", "z9", "漢", "c-d", "e"]) for _ in range(draw.randrange(9))), draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", None])) for _ in range(60)]
    rows += [(None, "xx", "s1"), ("", "xx", "s2"), ("never kept", "yy", "s1"), ("never", "yy", None), ("alone", "zz", "s")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    got = [tuple(r) for r in divergence.divergence(docs.repartition(3), 4, 3).collect()]
    assert sorted(got) == sorted(brute_divergence(rows, 4, 3))


def test_divergence_of_odd_rows(spark):
    rows = [(r[1], r[2], r[3]) for r in edge.rows()]
    got = [tuple(r) for r in divergence.divergence(edge.documents(spark), 2, 10).collect()]
    assert sorted(got) == sorted(brute_divergence(rows, 2, 10))
    assert divergence.divergence(edge.documents(spark, [])).count() == 0


def test_shares_beyond_64_bits(spark):
    """Counts of 10^13: the product with 10^9 needs more than 64 bits."""
    c, n, v = 10**13, 3 * 10**13 + 1, 7
    row = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (c + 2) // (n + 2 * v)
