"""Every catalogue query against its SQL."""

import math
import os
from glob import glob

import duckdb
import pytest

from braidgraph.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


def test_all_have_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    want = sorted(con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({SQL[name]})").fetchall(), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
