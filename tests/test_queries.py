"""Every registered query against its SQL twin in DuckDB."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarry.plans import all_oracle_sql, all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{x:.5f}"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return str(int(x)) if isinstance(x, np.integer) else str(x)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    got = all_queries()[name](spark, SF).toPandas()
    sql = all_oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
