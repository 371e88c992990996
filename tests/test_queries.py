import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docwright import plans

SMALL = "/root/testdata/sf0.001"


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, int) or v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in plans.SQL:
        assert got
        return
    r = con.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
