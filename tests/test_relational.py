"""Every query that has an oracle against it."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from helixframe import catalog


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    return con


def canonical(df):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 9) + 0.0)
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
