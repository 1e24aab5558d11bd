"""Every query of the engine against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from scanforge.plans import catalog, files, sections  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, list | tuple | np.ndarray):
        return tuple(map(plain, x))
    if isinstance(x, bool | np.bool_):
        return bool(x)
    if isinstance(x, float | np.floating):
        return round(float(x), 9) + 0.0
    return x.item() if isinstance(x, np.generic) else x


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(map(plain, t)) for t in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
