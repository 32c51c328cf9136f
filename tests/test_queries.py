"""Every registered query with SQL gives DuckDB's rows on the smallest tables; plans stay free of cross joins."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = sorted(entry.oracle_sql())


def cell(v):
    """A value as text to five digits; a missing value and NaN are different things."""
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[k]) for k in order) for r in values)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_every_query_has_a_callable():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    df, con = entry.queries()[name](spark, DATA), duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, con.fetchall())
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
