"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import os

import pytest

from pathgrove import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return c


def plain(v):
    return v.strftime("%F %T") if isinstance(v, dt.datetime) else repr(round(v, 9) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
