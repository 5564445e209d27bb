"""The queries with SQL give the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from tessera.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, small, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    result = connection.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sorted(map(tuple, frame.select(columns).collect())) == want
