"""The queries that SQL can express against it, over whole tables."""

import glob
import os

import duckdb
import pytest

from sentrel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in df.columns) for r in found.fetchall()), key=str)
    assert sorted(map(tuple, df.collect()), key=str) == want and want
