"""Queries that SQL can express, against it."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from helixframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    # a column of whole numbers and nulls comes as floats from pandas
    one = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    rows = lambda df: sorted(str([one(v) for v in row]) for row in df[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)
