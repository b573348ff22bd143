import glob
import os

import duckdb
import numpy as np
import pytest

from spanforge import oracles, queries

SLOW = set()
ORACLES = oracles.oracle_sql()


def normal(df):
    df = df[sorted(df.columns)].copy()
    number = lambda v: isinstance(v, (float, int, np.floating, np.integer)) and not isinstance(v, (bool, np.bool_))
    for c in df.columns:
        df[c] = df[c].map(lambda v: "NULL" if v is None or number(v) and v != v else repr(round(float(v), 6) + 0.0) if number(v) else str(v))
    return sorted(map(tuple, df.values.tolist()))


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, db, name):
    got = queries.queries()[name](spark, data).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        assert normal(got) == normal(db.sql(ORACLES[name]).df())
