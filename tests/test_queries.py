"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    cell = lambda v: "None" if v is None else repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    res = con.execute(catalog.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert norm(df.collect(), df.columns) == norm(res.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
