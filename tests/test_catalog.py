"""Every registered security query against its SQL on DuckDB, over the whole smallest tables."""

import glob
import os

import duckdb
import pytest

from sentrel.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return con


def plain(rows, order):
    return sorted(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = plain(df.collect(), [df.columns.index(c) for c in names])
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert got == plain(found.fetchall(), [columns.index(c) for c in names])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
