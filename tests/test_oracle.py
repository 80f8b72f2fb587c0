"""Every core query against the SQL that says the same, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from sievegrid.plans import catalogue


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


#: Queries without SQL, and how many rows of the smallest tables they give at least; their operators have tests of their own.
LEAST_ROWS = {"python_slices": 50, "documents_fingerprint": 1, "code_density": 50, "graph_pass": 100, "polyglot_slices": 20, "reasoning_vectors": 2}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, db, name):
    df = catalogue.queries()[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        got = db.execute(sql)
        names = [x[0] for x in got.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in got.fetchall())
    else:
        assert len(rows) >= LEAST_ROWS[name]


def test_sql_only_for_known_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_runs_without_the_training_data_operators():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
