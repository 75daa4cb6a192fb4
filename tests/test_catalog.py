"""Every reward query against its SQL oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillmark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def value(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    want = sorted(repr([value(x[names.index(c)]) for c in order]) for x in r.fetchall())
    assert sorted(repr([value(x[c]) for c in order]) for x in rows) == want
