"""Every registered query against its DuckDB text, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from lakeloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
queries.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    """A value with numbers of all types alike."""
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, dict):
        return str(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert rows
        return
    found = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_and_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
