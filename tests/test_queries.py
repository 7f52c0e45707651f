"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import pytest
from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v) if not isinstance(v, datetime.datetime) else v.isoformat()


def test_each_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want
