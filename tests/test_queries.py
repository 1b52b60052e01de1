"""Each query with SQL against DuckDB on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from ripplescope.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "part orders lineitem pages documents conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _row(values):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    expected = duck.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    key = lambda row: tuple(map(str, row))
    assert sorted((_row(r[c] for c in columns) for r in df.collect()), key=key) == sorted((_row(r[i] for i in at) for r in expected.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
