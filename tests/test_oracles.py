"""Every registered query of the station operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from aerosieve.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    q = db.execute(catalog.ORACLES[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in q.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
