"""Operators on literal rows, and against plain Python where the result is a fold."""

import hashlib
import json
import math
import random
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import text
from tessera.functions.text import excerpt
from tessera.operators import chunking, comparison, gates, index, metrics, profile, retrieval, state, telemetry, verify
from tessera.sources import files
from tessera.streaming import rollups


def rows(frame, *names):
    return sorted(map(tuple, frame.select(*names).collect()), key=str)


# chunks


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (10, 0), (10, 99), (1000, 10), (1, 0)])
def test_fixed_windows(spark, size, overlap):
    texts = ["abcdefghijklmnopqrstuvwxyz", "short", "", None, "0123456789", "01234567890"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    step = max(1, size - min(overlap, size - 1))
    want = []
    for i, t in enumerate(texts):
        start, k = 0, 0
        while t and start < len(t):
            want.append((i, k, t[start : start + size]))
            if start + size >= len(t):
                break
            start, k = start + step, k + 1
    assert rows(chunking.fixed_windows(docs, size, overlap), "doc_id", "chunk_index", "chunk_text") == sorted(want, key=str)


def plain_pieces(paragraph, size):
    """Sentences of a long paragraph packed one by one."""
    if len(paragraph) <= size:
        return [paragraph]
    out, held = [], ""
    for sentence in [s for s in re.split(r"(?<=[.!?])\s+", paragraph) if s]:
        longer = f"{held} {sentence}" if held else sentence
        if len(longer) <= size:
            held = longer
        elif held:
            out.append(held)
            held = sentence
        else:
            out += [x for x in (sentence[i : i + size].strip() for i in range(0, len(sentence), size)) if x]
    return [*out, held] if held else out


def plain_chunks(text, size, overlap):
    """(heading, text) chunks; headings of the made-up texts end in a colon."""
    out, heading, held = [], None, []
    pieces = [p for line in text.split("\n") if line.strip() for p in plain_pieces(line.strip(), size)]
    for piece in [*pieces, ":"]:
        head = piece.endswith(":") and len(piece) <= 90
        if held and (head or sum(map(len, held)) + 2 * len(held) + len(piece) > size):
            out.append((heading, "\n\n".join(([heading] if heading else []) + held)))
            carried = 1
            while carried < len(held) and sum(map(len, held[-carried:])) < overlap:
                carried += 1
            held = [] if head else held[-carried:]
        if head:
            heading, held = piece, []
        else:
            held = [*held, piece]
    return out


@pytest.mark.parametrize(("size", "overlap"), [(30, 8), (60, 25), (45, 200), (20, 0)])
def test_structured_chunks(spark, size, overlap):
    rng = random.Random(size)
    sentence = lambda: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))) + rng.choice([".", "!", "", "?"])
    lines = lambda: [sentence() + ":" if rng.random() < 0.15 else " ".join(sentence() for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 25))]
    texts = ["\n".join(lines()) for _ in range(60)] + ["x" * 150, "ab. " + "y" * 100 + ". cd.", "Only:", "A heading:\nAnother:\ntext under it", ""]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    found = {}
    for r in chunking.structured_chunks(docs, size, overlap).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r["doc_id"], []).append((r["section_heading"], r["chunk_text"]))
        assert r["chunk_index"] == len(found[r["doc_id"]]) - 1
    assert found == {k: want for k, t in enumerate(texts) if (want := plain_chunks(t, size, overlap))}


def test_overlap_is_carried(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a" * 10, "b" * 10, "c" * 10]))], "doc_id int, text string")
    out = chunking.structured_chunks(docs, 26, 5).orderBy("chunk_index").collect()
    assert [r["chunk_text"] for r in out] == ["a" * 10 + "\n\n" + "b" * 10, "b" * 10 + "\n\n" + "c" * 10]


def test_pages_are_numbered_through(spark):
    chunks = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 1, 0)], "doc_id int, page_number int, chunk_index int")
    assert rows(chunking.number_across_pages(chunks), "doc_id", "page_number", "chunk_index") == [(1, 1, 0), (1, 1, 1), (1, 2, 2), (2, 1, 0)]


# index


def test_best_chunks_are_scored_in_blocks(spark, monkeypatch):
    """bm25_top_k gives the best of bm25_scores, ties and repeats included, without shuffling those scores."""
    words = ["red", "apple", "wine", "list", "pie", "the", "青", "x1"]
    texts = [" ".join(words[(i * j + j // 3) % len(words)] for j in range(i % 9)) for i in range(120)] * 2
    chunks = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "doc_id int, chunk_index int, chunk_text string").repartition(3)
    asked = spark.createDataFrame([(7, "red apple pie"), (3, "wine wine 青"), (5, "nothing"), (9, "the"), (None, "red"), (11, None)], "query_id long, query string")
    found = index.bm25_top_k(chunks, asked, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(found, *found.columns) == rows(index.top_k(index.bm25_scores(chunks, asked), 4, ties=(F.desc("keyword"), "doc_id", "chunk_index")), *found.columns)
    assert index.bm25_top_k(chunks, asked.where("query_id = 9"), 4).count() == 0 and index.bm25_top_k(chunks.limit(0), asked, 4).count() == 0
    # a batch in several blocks scores as in one
    batch = index.wanted_counts(pa.record_batch({"id": range(len(texts)), "terms": [t.split() for t in texts]}), pa.array(["red", "wine"]))
    whole = [(b["id"].to_pylist(), s.tolist(), n.tolist()) for b, s, n in index.scored_blocks(batch, np.array([0.5, 2.0]), 4.0, np.array([0, 1, 1]), np.array([0, 2, 3]), 2)]
    assert len(whole) == 1 and batch["length"].to_pylist() == [len(t.split()) for t in texts]
    for name, bound in (("BLOCK_MATCHES", 5), ("BLOCK_CELLS", 14)):
        monkeypatch.setattr(index, name, bound)
        parts = list(index.scored_blocks(batch, np.array([0.5, 2.0]), 4.0, np.array([0, 1, 1]), np.array([0, 2, 3]), 2))
        assert len(parts) > 10 and np.concatenate([s for _, s, _ in parts], axis=1).tolist() == whole[0][1] and np.concatenate([n for _, _, n in parts], axis=1).tolist() == whole[0][2]


@pytest.mark.parametrize("cjk", [True, False])
def test_terms_are_read_by_batches(spark, cjk):
    """term_lists() gives the terms of functions.text.terms(), also of slices, nulls and large strings."""
    texts = ["Red wine, the-apple's PIE", None, "", " \n\t", "x 1 a2 ÄÖstraße café KELVIN\u212a İx ſt", "the policy", "a\x00b\u2028cd", "naïve\U0001f600emoji99", "z" * 3000] + ["青苹果 red哪些x1y", "䷿一鿿ꀀ"] * cjk
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    want = [r["w"] for r in docs.select("n", text.terms(F.col("t")).alias("w")).orderBy("n").collect()]
    assert index.term_lists(pa.array(texts)).to_pylist() == want and index.term_lists(pa.array(texts, pa.large_string())).to_pylist() == want
    assert index.term_lists(pa.array(texts)[3:]).to_pylist() == want[3:] and index.term_lists(pa.array([], pa.string())).to_pylist() == []


def test_texts_are_read_into_terms_outside_plans(spark):
    """bm25_top_k hands texts on as they are: no list of terms is made by a plan."""
    chunks = spark.createDataFrame([(1, 0, "red wine"), (2, 0, None), (3, 0, "red red pie")], "doc_id long, chunk_index int, chunk_text string")
    asked = spark.createDataFrame([(7, "red apple pie"), (3, "wine")], "query_id long, query string")
    read = index.read_once(chunks, asked)
    assert read.rows.orderBy("doc_id").select("length", "counts").collect() == [(2, [1, 1]), (0, []), (3, [2, 1])]
    # another search of some of the terms gives what it gives alone, without reading the chunks again
    fewer = asked.where("query_id = 7").select("query_id", F.lit("pie").alias("query"))
    found, alone = index.bm25_top_k(read, fewer, 2), index.bm25_top_k(chunks, fewer, 2)
    assert rows(found, *found.columns) == rows(alone, *alone.columns) and found.count() == 1
    assert index.bm25_top_k(read, asked.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        index.bm25_top_k(read, asked.select("query_id", F.lit("plum").alias("query")), 2)


def test_more_query_terms_are_not_read_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, 0, "red wine"), (3, 0, "red red pie")], "doc_id long, chunk_index int, chunk_text string")
    asked = spark.createDataFrame([(7, "red apple pie")], "query_id long, query string")
    found = rows(index.bm25_top_k(chunks, asked, 2), "query_id", "doc_id", "score", "rank")
    monkeypatch.setattr(index, "FEW_ROWS", 1)
    assert index.read_once(chunks, asked) is chunks and rows(index.bm25_top_k(chunks, asked, 2), "query_id", "doc_id", "score", "rank") == found


def test_gap_searches_read_the_chunks_once(spark, small, monkeypatch):
    calls, plain = [], index.counted_terms
    monkeypatch.setattr(index, "counted_terms", lambda *a, **b: calls.append(a) or plain(*a, **b))
    assert registry.QUERIES["gap_searches"](spark, small).count() >= 0 and len(calls) == 1


def test_tidy_texts_are_not_worked_on(spark):
    """tidy() gives normalize_whitespace(), whatever stands in a text."""
    parts = ["", " ", "  ", "a", "\n", "\n\n", "\t", "\r", "\x00", "\x0b", "b c"]
    texts = [a + b + c + d for a in parts for b in parts for c in parts for d in parts] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    assert docs.where(~text.tidy(F.col("t")).eqNullSafe(text.normalize_whitespace(F.col("t")))).count() == 0


def test_dense_entries_are_scored_where_they_are_read(spark, monkeypatch):
    """dense_top_k gives the best of dense_blocks, ties included, without shuffling entries, and reads terms made before."""
    words = ["red", "apple", "wine", "list", "pie", "the", "青", "x1"]
    texts = [" ".join(words[(i * j + j // 3) % len(words)] for j in range(i % 9)) for i in range(120)] * 2
    chunks = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "doc_id int, chunk_index int, chunk_text string").repartition(3)
    asked = spark.createDataFrame([(7, "red apple pie"), (3, "wine wine 青"), (5, "nothing"), (9, "the"), (11, None)], "query_id long, query string")
    found = retrieval.dense_top_k(chunks, asked, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = rows(found, *found.columns)
    assert got == rows(retrieval.dense_top_k(index.written_terms(chunks), asked, 4), *found.columns)
    assert retrieval.dense_top_k(chunks, asked.where("query_id = 9"), 4).count() == 0 and retrieval.dense_top_k(chunks.limit(0), asked, 4).count() == 0
    assert got == rows(retrieval.dense_top_k(chunks, asked, 4, embed=lambda lists: retrieval.hash_embed(lists)), *found.columns)
    monkeypatch.setattr(index, "BLOCK_CELLS", 14)
    assert got == rows(retrieval.dense_top_k(chunks, asked, 4), *found.columns)
    monkeypatch.setattr(retrieval, "FEW_ROWS", 1)
    assert got == rows(retrieval.dense_top_k(chunks, asked, 4), *found.columns) and len(got) >= 8


def test_both_sides_read_terms_once(spark, small, monkeypatch):
    from tessera.plans import retrieval as plans

    cut = []
    monkeypatch.setattr(plans, "chunks", lambda *at, real=plans.chunks: cut.append(at) or real(*at))
    plans.hybrid_topk(spark, small)
    assert len(cut) == 1


def test_runs_are_found_where_documents_are_read(spark):
    """Every document that holds a passage is found, without a row for each of its runs."""
    asked = [(1, "the quick brown fox jumps over it"), (2, "a b c d e f g h"), (3, "un deux\u00a0trois quatre\x1ccinq six sept huit neuf dix"), (4, "a b c d e f g h")]
    texts = [f"x{p}y" for _, p in asked] + ["the quick brown\tfox jumps over it", "quick brown fox jumps over", "b c d e", "", None, "b c d e f " * 3, " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    passages = spark.createDataFrame(asked, "query_id int, query string").select("query_id", F.split("query", r"\s+").alias("words"))
    near = index.run_holders(docs, passages, True)
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    got = set(rows(near, "doc_id", "query_id"))
    assert got >= {(d, q) for d, t in enumerate(texts) for q, p in asked if t and p in t} and {(4, 1), (5, 1), (9, 2), (9, 4)} <= got and {d for d, _ in got} <= {0, 1, 2, 3, 4, 5, 9}
    assert got == set(rows(index.run_holders(docs, passages, False), "doc_id", "query_id"))
    assert index.run_holders(docs, passages.limit(0), True).count() == 0


@pytest.mark.parametrize("module, name", [("summaries", "evidence_summary"), ("summaries", "result_counts")])
def test_texts_are_read_into_terms_once(spark, small, monkeypatch, module, name):
    import importlib

    from tessera.plans import retrieval as plans

    cut, owner = [], importlib.import_module(f"tessera.plans.{module}")
    for place in (plans, owner):
        if hasattr(place, "chunks"):
            monkeypatch.setattr(place, "chunks", lambda *at, real=place.chunks: cut.append(at) or real(*at))
    getattr(owner, name)(spark, small)
    assert len(cut) == 1


def test_windows_count_code_points(spark):
    texts = ["\U0001f34e" * 30 + "ab" * 20, " \x0b\r\n x \x00y\f ", "\r\x00", "", "é" * 11, "a" * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    body = [t.replace("\x00", "").replace("\r", "").strip(" \t\n\x0b\f") for t in texts]
    want = [(d, i // 7, b[i : i + 10].strip(" \t\n\x0b\f")) for d, b in enumerate(body) for i in range(0, len(b), 7) if i == 0 or i + 3 < len(b)]
    assert rows(chunking.fixed_windows(docs, 10, 3), "doc_id", "chunk_index", "chunk_text") == sorted(want, key=str)


def test_bm25_against_plain_python(spark):
    texts = ["red apple apple pie", "green apple", "red red wine", "the of", "wine list"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, chunk_index int, chunk_text string")
    asked = {1: "red apple", 2: "wine wine", 3: "nothing here", 4: "the"}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.bm25_scores(chunks, spark.createDataFrame(list(asked.items()), "query_id int, query string")).collect()}
    bags = [[w for w in t.split() if w not in ("the", "of")] for t in texts]
    mean = sum(map(len, bags)) / len(bags)
    want = {}
    for q, query in asked.items():
        for d, bag in enumerate(bags):
            score = 0
            for t in set(query.split()) - {"the", "here"}:
                df, tf = sum(t in b for b in bags), bag.count(t)
                score += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
            if score:
                want[q, d] = round(score, 6)
    assert got == pytest.approx(want, abs=2e-6)


def test_index_changes(spark):
    schema = "doc_id int, chunk_index int, v string"
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], schema)
    new = spark.createDataFrame([(1, 0, "A"), (3, 0, "d")], schema)
    assert rows(index.upsert(old, new), "doc_id", "chunk_index", "v") == [(1, 0, "A"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")]
    assert rows(index.replace_documents(old, new), "doc_id", "v") == [(1, "A"), (2, "c"), (3, "d")]
    assert rows(index.delete(old, new), "doc_id") == [(2,)]


def test_profiles(spark):
    docs = spark.createDataFrame([(1, "Budget budget travel. Travel to ACME Corp by ACME Corp. A third sentence of some length."), (2, "the of"), (3, None)], "doc_id int, text string")
    assert rows(profile.tags(docs, 2), "doc_id", "tag_rank", "tag") == [(1, 1, "budget"), (1, 2, "travel")]
    assert rows(profile.entities(docs, 1), "doc_id", "entity", "n") == [(1, "ACME Corp", 2)]
    assert rows(profile.group_by_tag(docs), "label", "documents") == [("budget", 1), ("untagged", 2)]
    assert rows(profile.discover(docs, "Which travel budget?"), "doc_id", "score") == [(1, 2)]


def test_discover_reads_each_text_once(spark):
    texts = ["Tra\x00vel", "TRAVEL bud\rget", "tra vel", None, "", "budget-budget"]
    found = profile.discover(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "Which travel budget?")
    assert [tuple(r) for r in found.collect()] == [(1, 2), (0, 1), (5, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "regexp_replace" not in plan


# retrieval


def results(spark, data):
    return spark.createDataFrame(data, "query_id int, doc_id int, score double").withColumn("rank", F.lit(0))


def test_weighted_fusion(spark):
    out = retrieval.weighted_fusion(results(spark, [(1, 1, 0.8), (1, 2, 0.4)]), results(spark, [(1, 2, 5.0), (1, 3, 2.5)]), ("doc_id",))
    assert rows(out, "doc_id", "score") == [(1, 0.65), (2, 0.675), (3, 0.175)]
    flat = retrieval.weighted_fusion(results(spark, [(1, 1, 0.0)]), results(spark, [(1, 1, 0.0)]), ("doc_id",), 0, 0)
    assert rows(flat, "doc_id", "score") == [(1, 0.0)]


def test_rrf(spark):
    side = lambda data: spark.createDataFrame(data, "query_id int, doc_id int, rank int")
    out = retrieval.rrf_fusion(side([(1, 1, 1), (1, 2, 2)]), side([(1, 2, 1)]), ("doc_id",))
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    assert got == pytest.approx({1: 0.65 / 61, 2: 0.65 / 62 + 0.35 / 61}, abs=1e-8)
    assert max(got.values()) < retrieval.MIN_SCORE  # so that rank fusion alone never passes the gate


def test_cosine_blocks_equal_brute_force(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(40, 5))
    vectors[7] = 0
    frame = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    asked = frame.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(x["query_id"], x["rank"]): x["score"] for x in retrieval.cosine_top_k(frame, asked, 3).collect()}
    size = np.linalg.norm(vectors, axis=1)
    for q in range(0, 40, 4):
        all_ = sorted((float(vectors[q] @ vectors[i] / (size[q] * size[i])) if size[q] * size[i] else 0.0 for i in range(40) if i != q), reverse=True)
        assert [got[q, k] for k in (1, 2, 3)] == pytest.approx(all_[:3], abs=1e-4)
    assert retrieval.cosine_top_k(frame.limit(0), asked, 3).count() == 0


def test_sparse_vectors_of_listed_and_other_terms(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["大", "中"]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randrange(1, 40))) for _ in range(80)] + ["", "a", None, "only once"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, chunk_index int, chunk_text string")
    terms = {i: [w for w in re.findall("[a-z0-9]+|[一-鿿]", t or "") if w != "a"] for i, t in enumerate(texts)}
    df = {w: sum(w in ts for ts in terms.values()) for ts in terms.values() for w in ts}
    mean, want = sum(map(len, terms.values())) / len(terms), {}
    for i, ts in terms.items():
        weight = lambda w: math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * ts.count(w) * 2.2 / (ts.count(w) + 1.2 * (0.25 + 0.75 * len(ts) / mean))  # noqa: B023, E731
        want |= {i: [(w, round(weight(w), 6)) for w in sorted(set(ts))]} if ts else {}
    for listed in (0, 1, 7, 1000):
        found = index.sparse_vectors(chunks, listed=listed)
        got = {x["doc_id"]: [(e["term"], pytest.approx(e["weight"], abs=2e-6)) for e in x["entries"]] for x in found.collect()}
        assert got == want
    # where all terms are listed, no posting is shuffled
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert index.sparse_vectors(chunks.limit(0)).count() == 0


def test_rerank_promotes_the_phrase(spark):
    data = [(1, 1, 0, 1.0, "unrelated words only"), (1, 2, 0, 0.5, "the travel budget is here"), (1, 3, 0, 0.4, "travel without money")]
    found = spark.createDataFrame(data, "query_id int, doc_id int, chunk_index int, score double, chunk_text string")
    asked = spark.createDataFrame([(1, 'the "travel budget"')], "query_id int, query string")
    out = retrieval.heuristic_rerank(found, asked, 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == [2, 1] and out[0]["rerank"] == 1.0
    assert out[0]["score"] == pytest.approx(0.5 * 0.4 + 0.6)


def test_minmax_and_flat_scores(spark):
    found = spark.createDataFrame([(1, 1, 0, 0.5, 3.0), (1, 2, 0, 0.5, 1.0), (2, 1, 0, 0.5, 0.7), (2, 2, 0, 0.4, 0.7)], "query_id int, doc_id int, chunk_index int, score double, m double")
    got = {(r["query_id"], r["doc_id"]): r["rerank"] for r in retrieval.minmax_rerank(found, F.col("m"), 5).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.7, (2, 2): 0.7}


def test_confidence(spark):
    asked = spark.createDataFrame([(1, "plain words"), (2, "code AB-12 please"), (3, "code AB-12 please"), (4, "none")], "query_id int, query string")
    data = [
        (1, 1, 0.9, 0.2, "x"), (1, 2, 0.4, None, "x"), (2, 1, 0.3, 0.9, "about AB-12"), (2, 2, 0.9, 0.9, "other"), (3, 1, 0.9, 0.9, "other code"), (4, 1, 0.1, 0.9, "x"),
    ]
    found = spark.createDataFrame(data, "query_id int, doc_id int, score double, keyword double, chunk_text string")
    out = {r["query_id"]: (r["confident"], r["usable"], r["missing"], r["failure"]) for r in retrieval.confidence(found, asked).collect()}
    assert out == {1: (True, 1, 0, None), 2: (True, 1, 0, None), 3: (False, 0, 1, "missing_anchor_coverage"), 4: (False, 0, 0, "low_relevance")}
    selected = spark.createDataFrame([(1, 1), (1, 2), (4, 1), (2, 1)], "query_id int, doc_id int")
    usable = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, 1)], "query_id int, doc_id int, usable int")
    assert rows(retrieval.comparison_confidence(usable, selected), "query_id", "covered", "confident") == [(1, 2, True), (2, 1, True), (4, 0, False)]


def test_merge_keeps_first_places(spark):
    data = [(1, 0, 1, 5, 0.2, 0.1), (1, 0, 2, 6, 0.9, 0.1), (1, 1, 1, 5, 0.1, 0.9), (1, 1, 2, 7, 0.1, None)]
    found = spark.createDataFrame(data, "question_id int, sub_query int, position int, doc_id int, score double, keyword double")
    assert rows(retrieval.merge_queries(found, ("doc_id",)), "place", "doc_id", "score", "from_query") == [(1, 5, 0.1, 1), (2, 6, 0.9, 0), (3, 7, 0.1, 1)]


@pytest.mark.parametrize(("query", "n", "mode"), [("Compare both policies", 2, "compare"), ("Compare both policies", 1, "qa"), ("what is the limit", 3, "qa"), ("两个文档有什么区别", 2, "compare"), (None, 2, "qa")])
def test_route(spark, query, n, mode):
    row = spark.createDataFrame([(query, n)], "q string, n int").select(*[c.alias(a) for c, a in zip(retrieval.route(F.col("q"), F.col("n")), ("mode", "sure"))]).first()
    assert row["mode"] == mode and 0 <= row["sure"] <= 1


# comparison

BASE = "Employees must book travel in advance. The limit is 50 dollars. Managers approve every trip before it starts. Receipts are kept for 7 years."


def pairs(spark, *texts):
    evidence = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "group_id int, doc_id int, text string")
    return comparison.analyse_pairs(comparison.evidence_features(evidence))


@pytest.mark.parametrize(
    ("other", "near", "exact", "conflict"),
    [
        (BASE, True, True, False),
        (BASE.replace("50", "50.00"), True, True, False),
        (BASE.replace("50", "75"), True, False, True),
        (BASE.replace("50", "x").replace("7", "50").replace("x", "7"), True, False, True),
        (BASE.replace("must", "need not").replace("Employees", "It is optional that employees"), True, False, True),
        ("Something else entirely about gardens.", False, False, False),
    ],
)
def test_pairs(spark, other, near, exact, conflict):
    row = pairs(spark, BASE, other).first()
    assert (row["near_duplicate"], row["exact_match"], row["explicit_conflict"]) == (near, exact, conflict)


def test_verdicts(spark):
    found = pairs(spark, BASE, BASE)
    chosen = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (2, 0, 0), (2, 1, 1)], "group_id int, doc_id int, results int")
    out = {r["group_id"]: r for r in comparison.verdicts(found, chosen).collect()}
    assert out[1]["no_difference"] and out[1]["balance"] == "skewed" and out[1]["missing"] == 0
    assert not out[2]["no_difference"] and out[2]["missing"] == 1 and out[2]["pairs"] == 0
    assert pairs(spark, BASE, " ").count() == 0


def test_source_bundle(spark):
    data = [(1, 1, 0, 0.9, "shared line."), (1, 1, 1, 0.5, "only here 42."), (1, 1, 2, 0.6, "shared line."), (1, 2, 0, 0.8, "shared line.")]
    out = comparison.source_bundle(spark.createDataFrame(data, "group_id int, doc_id int, chunk_index int, score double, text string"), documents=2)
    assert rows(out, "source_rank", "doc_id", "chunk_index", "role") == [(1, 1, 0, "best"), (2, 2, 0, "best"), (3, 1, 1, "extra")]


# metrics and gates


def test_ranking_metrics(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3), (2, 12, 1)], "query_id int, doc_id int, rank int")
    expected = spark.createDataFrame([(1, 11), (1, 13), (3, 14)], "query_id int, doc_id int")
    out = {r["query_id"]: r for r in metrics.ranking_metrics(ranking, expected, 3).collect()}
    assert out[1]["ndcg"] == pytest.approx((3 / math.log2(3)) / (3 + 3 / math.log2(3)), abs=1e-4)
    assert (out[1]["precision"], out[1]["recall"], out[1]["mrr"], out[1]["noise"]) == (0.3333, 0.5, 0.5, 0.6667)
    assert out[2]["ndcg"] is None and out[2]["recall"] is None and out[2]["mrr"] == 0 and out[2]["noise"] == 1
    assert out[3]["ndcg"] == 0 and out[3]["precision"] is None and out[3]["noise"] is None


def test_only_the_first_hit_counts(spark):
    ranking = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "query_id int, doc_id int, rank int")
    expected = spark.createDataFrame([(1, 5)], "query_id int, doc_id int")
    assert rows(metrics.relevant_first(ranking, expected), "rank", "grade") == [(1, 2), (2, 0)]


def test_percentiles(spark):
    values = spark.range(1, 101).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("value"))
    row = metrics.percentiles(values, ("g",)).first()
    assert (row["p50"], row["p90"], row["p95"], row["p99"], row["least"], row["most"], row["n"]) == (50, 90, 95, 99, 1, 100, 100)


def test_percentiles_of_ties_skew_and_null_groups(spark):
    import random

    r = random.Random(2)
    groups = {"same": [3.0] * 7, "one": [5.0], "skewed": [1.0] * 90 + [10.0**k for k in range(12)], "random": [r.gauss(0, 100) + 1000 for _ in range(999)], None: [2.0, 1.0], "none": []}
    data = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    out = {x["g"]: x for x in metrics.percentiles(spark.createDataFrame(data, "g string, value double"), ("g",)).collect()}
    assert set(out) == {g for g, vs in groups.items() if vs}
    for g, vs in groups.items():
        for q in (50, 90, 95, 99) if vs else ():
            assert abs(out[g][f"p{q}"] - sorted(vs)[max(1, -(-len(vs) * q // 100)) - 1]) < 1e-3


@pytest.mark.parametrize(("fall", "want"), [(0.0, "pass"), (0.01, "warn"), (0.03, "fail"), (-0.5, "pass"), (None, "unknown")])
def test_regression(spark, fall, want):
    one = lambda v: spark.createDataFrame([(v,)], "ndcg double")
    checks = gates.regression_gate(one(0.9), one(None if fall is None else 0.9 - fall), {"ndcg": (0.01, 0.03)})
    assert checks.first()["status"] == want
    assert gates.worst_status(checks).first()["status"] == {"unknown": "pass"}.get(want, want)


@pytest.mark.parametrize(("latency", "limit", "want"), [(10.0, 20, "pass"), (20.0, 20, "pass"), (21.0, 20, "breach"), (None, 20, "unavailable"), (5.0, None, "unavailable"), (-1.0, 5, "unavailable")])
def test_slo(spark, latency, limit, want):
    assert spark.createDataFrame([(latency, limit)], "a double, b int").select(gates.slo_status(F.col("a"), F.col("b"))).first()[0] == want


def test_rollups(spark):
    calls = spark.createDataFrame([("op", "r1", "ok", 1.0, 2, 0.5, "pass"), ("op", "r2", "error", 3.0, None, None, "breach")], "operation string, route string, status string, latency_ms double, tokens long, cost double, slo string")
    out = {(r["grain"], r["name"]): r for r in telemetry.llmops_rollup(calls).collect()}
    assert set(out) == {("all", ""), ("operation", "op"), ("route", "r1"), ("route", "r2")}
    assert out["all", ""]["error_rate"] == 0.5 and out["all", ""]["mean_latency"] == 2.0 and out["route", "r1"]["tokens"] == 2
    cases = spark.createDataFrame([("qa", True), ("qa", False), ("compare", None)], "type string, passed boolean")
    assert tuple(telemetry.conditional_rates(cases, {"qa": ("passed", "type = 'qa'"), "none": ("passed", "type = 'x'")}).first()) == (0.5, None)


# stores


def test_state_machines(spark):
    history = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "completed"), (1, 4, "running"), (2, 1, "failed"), (2, 2, "queued"), (2, 3, "queued")], "run_id int, seq int, status string")
    assert rows(state.illegal_transitions(history), "run_id", "seq", "previous") == [(1, 4, "completed")]


def test_claims_of_tasks(spark):
    stamp = datetime.fromisoformat
    data = [(1, "queued", None, None, 0), (2, "queued", stamp("2024-01-02"), None, 1), (3, "running", None, stamp("2024-01-01"), 2), (4, "running", None, stamp("2024-01-03"), 0), (5, "completed", None, None, 0)]
    tasks = spark.createDataFrame(data, "task_id int, status string, due_at timestamp, lease_until timestamp, attempt int")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert rows(state.claimable(tasks, now), "task_id", "why", "attempt") == [(1, "queued", 1), (3, "expired", 3)]


def test_stores(spark):
    docs = spark.createDataFrame([(1, "me", "w"), (2, "you", "w"), (3, "you", None), (4, None, None)], "doc_id int, owner string, workspace string")
    assert rows(docs.where(state.in_scope("me", "w")), "doc_id") == [(1,), (2,), (4,)]
    existing = spark.createDataFrame([("a", 1)], "key string, v int")
    arrivals = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2)], "key string, v int")
    assert rows(state.insert_new(existing, arrivals, "key"), "key", "v") == [("b", 2)]
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", "x" * 800) for i in range(9)], "conv_id int, turn int, role string, text string")
    assert rows(state.recent_messages(turns).select("turn", F.length("text").alias("n")), "turn", "n") == [(3, 400), (4, 700), (5, 400), (6, 700), (7, 400), (8, 700)]
    assert state.audit_page(docs, 1, 1, [F.col("doc_id")], owner="you").first()["total"] == 2


def test_uploads(spark):
    data = [("u", 1, 2, "b"), ("u", 0, 2, "ä"), ("u", 0, 2, "ä"), ("v", 1, 2, "x")]
    out = {r["upload_id"]: r for r in state.merge_uploads(spark.createDataFrame(data, "upload_id string, part int, total int, body string")).collect()}
    assert out["u"]["complete"] and out["u"]["sha256"] == hashlib.sha256("äb".encode()).hexdigest() and out["u"]["bytes"] == 3
    assert not out["v"]["complete"] and out["v"]["sha256"] is None


# claims


def test_claims(spark):
    text = "# Differences\n- Policy A allows 5 days. [Source 1] Policy B allows 7 days [Source 2].\nNotes:\n1. All is well; nothing else follows\nthe of"
    out = verify.claims(spark.createDataFrame([(1, text), (2, None)], "answer_id int, text string")).orderBy("claim_index").collect()
    assert [(r["claim"], r["section"], r["ranks"]) for r in out] == [
        ("Policy A allows 5 days", "differences", [1]), ("Policy B allows 7 days", "differences", [2]), ("All is well", "notes", []), ("nothing else follows", "notes", []),
    ]


@pytest.mark.parametrize(
    ("claim", "want"),
    [
        ("Remote staff may claim 50 dollars for internet", True),
        ("Remote staff may claim 60 dollars for internet", False),
        ("Remote staff may not claim 50 dollars for internet", False),
        ("Remote staff must claim 50 dollars for internet", False),
        ("Gardens grow faster in spring", False),
    ],
)
def test_support(spark, claim, want):
    answers = spark.createDataFrame([(1, claim + " [Source 1].")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, 1, 7, "Intro text. Remote staff may claim 50 dollars for internet costs."), (1, 2, 8, claim + ".")], "answer_id int, rank int, doc_id int, text string")
    found = verify.claims(answers)
    checked = verify.check_claims(found, sources)
    assert checked.first()["supported"] is want
    verdict = verify.answer_verdicts(answers, checked, sources).first()
    assert ("unsupported_claims" in verdict["reasons"]) is not want and "document_coverage" in verdict["reasons"]
    grounded = verify.grounded_answers(found, checked).first()
    assert grounded["text"] == (claim + "." if want else "The documents do not answer this.")


def test_missing_source(spark):
    answers = spark.createDataFrame([(1, "Trips need approval [Source 3]."), (2, "")], "answer_id int, text string")
    sources = spark.createDataFrame([(1, 1, 7, "Trips need approval.")], "answer_id int, rank int, doc_id int, text string")
    checked = verify.check_claims(verify.claims(answers), sources)
    assert checked.first()["missing_ranks"] == 1 and not checked.first()["supported"]
    reasons = {r["answer_id"]: r["reasons"] for r in verify.answer_verdicts(answers, checked, sources).collect()}
    assert reasons[2].startswith("empty_answer,no_citations")
    better = verify.better_answers(spark.createDataFrame([(1, 3), (2, 3)], "answer_id int, score int"), spark.createDataFrame([(1, 4), (2, 3), (3, 0)], "answer_id int, score int"))
    assert rows(better, "answer_id", "chosen") == [(1, "second"), (2, "first"), (3, "second")]


# files and streams


def test_json_lines(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{bad\n{"id": 2}\n')
    lines = files.read_json_lines(spark, str(tmp_path), T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType())]))
    assert tuple(files.count_lines(lines).first()) == (2, 1)
    files.append_json_lines(lines.where("id = 1").drop(files.BAD), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_corpus(spark, tmp_path):
    corpus = {"documents": [{"key": "a", "fileName": "a.pdf", "pages": ["one-\ntwo", "x"]}], "cases": [{"id": "c", "type": "qa", "question": "?", "docKeys": ["a"], "shouldAbstain": False, "expectedEvidence": [{"docKey": "a", "pages": [2]}]}, {"id": "d", "type": "qa", "question": "?", "docKeys": [], "shouldAbstain": True, "expectedEvidence": []}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus, indent=1))
    pages, units = files.read_corpus(spark, str(tmp_path / "c.json"))
    assert rows(pages, "doc_key", "page_number", "text") == [("a", 1, "onetwo"), ("a", 2, "x")]
    assert rows(units, "case_id", "doc_key", "page_number") == [("c", "a", 2), ("d", None, None)]


def test_written_index(spark, tmp_path):
    rows_ = spark.createDataFrame([(i, 0, f"t{i}") for i in range(20)], "doc_id int, chunk_index int, v string")
    files.write_index(rows_, str(tmp_path / "i"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 20


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    stamps = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 09:00:00", "2024-01-02 12:00:00"]
    events = pd.DataFrame({"user_id": [1, 1, 1, 1, 2], "ts": pd.to_datetime([*stamps, stamps[0]])})
    late = pd.DataFrame({"user_id": [9], "ts": pd.to_datetime(["2024-02-01"])})
    path = tmp_path / "in"
    path.mkdir()
    for k, part in enumerate((events, late)):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(path / f"p{k}"))
    stream = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))
    query = rollups.sessions_by_gap(stream, late="0 seconds").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rows(rollups.sessions_by_gap(spark.createDataFrame(events)), "user_id", "started", "ended", "events")
    assert rows(spark.table("closed"), "user_id", "started", "ended", "events") == want


def test_term_counts_follow_a_stream(spark, tmp_path):
    one = spark.createDataFrame([("red apple",), ("red wine red",)], "chunk_text string")
    two = spark.createDataFrame([("apple pie",)], "chunk_text string")
    after = rollups.merge_term_counts(rollups.merge_term_counts(None, one), two)
    assert rows(after, "term", "df") == [("apple", 2), ("pie", 1), ("red", 2), ("wine", 1)]
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_text string").parquet(str(tmp_path / "in"))
    rollups.follow_term_counts(spark, stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert rows(rollups.term_counts(spark, str(tmp_path / "out")), "term", "df") == [("apple", 1), ("red", 2), ("wine", 1)]


def test_term_counts_are_compacted(spark, tmp_path):
    """A file a batch; the sum stays right whatever was compacted."""
    for k in range(5):
        spark.createDataFrame([(f"red w{k} apple",), ("red",)], "chunk_text string").coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema("chunk_text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rollups.follow_term_counts(spark, stream, str(tmp_path / "out"), str(tmp_path / "c"), compact_every=2).awaitTermination()
    assert (tmp_path / "out/kind=whole").is_dir()
    assert rows(rollups.term_counts(spark, str(tmp_path / "out")), "term", "df") == [("apple", 5), ("red", 10), *((f"w{k}", 1) for k in range(5))]


def test_excerpt(spark):
    assert spark.range(1).select(excerpt(F.lit(" a \n b "), 3)).first()[0] == "a b"


def test_pages_after_a_row_join_to_the_whole(spark):
    log = [(k, 1, "x" if k % 3 else "y") for k in range(7)] + [(k, 2, "x") for k in range(7, 12)] + [(99, None, "x"), (None, 1, "x")]
    frame = spark.createDataFrame(log, "id int, ts int, kind string")
    last, seen = None, []
    while page := [(r["ts"], r["id"]) for r in state.audit_after(frame, last, 4, kind="x").collect()]:
        seen += page
        last = spark.createDataFrame([page[-1]], "ts int, id int")
    assert seen == sorted(((t, k) for k, t, kind in log if kind == "x" and t and k is not None), reverse=True)
    assert state.audit_after(frame, last.where("false"), 4, kind=None).count() == 4
