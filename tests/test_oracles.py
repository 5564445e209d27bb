"""Every query with SQL gives the rows that DuckDB gives on the same tables; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value):.9g}"


def test_driver_contract(spark):
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(registry.QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    rows = sorted(tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    if name not in registry.ORACLES:
        assert rows
        return
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.fixture(scope="module")
def cut_passage(tmp_path_factory):
    """A passage that repeats a term and ends in a stop word. One long document holds it cut before that word; nine
    shorter ones hold its terms in other order."""
    folder = str(tmp_path_factory.mktemp("cut_passage"))
    texts = ["red blue red stone " + "filler " * 9] + [f"stone red red blue number{i}" for i in range(9)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, 'en', 'src0')", list(enumerate(texts)))
    connection.execute("CREATE TABLE benchmark AS SELECT CAST(0 AS BIGINT) AS item_id, 'Red blue red stone in' AS text")
    for name in ("documents", "benchmark"):
        connection.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, connection


@pytest.mark.parametrize("name", ["attached_evidence", "evidence_summary", "heuristic_rerank", "qa_sources", "result_counts", "result_traces"])
def test_a_reranked_passage_repeats_its_terms(spark, cut_passage, name):
    folder, connection = cut_passage
    frame = registry.QUERIES[name](spark, folder)
    result = connection.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    rows = sorted(tuple(map(plain, r)) for r in frame.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in result.fetchall())
