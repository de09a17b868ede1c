"""Every query beside its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docgraph import plans


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, db, name):
    df = plans.QUERIES[name](spark, sf)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in plans.ORACLES:
        assert df.columns
        return
    found = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(got) == sorted(want)
