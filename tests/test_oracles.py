"""Every query of the library against its SQL, at the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quern.plans import ORACLES, QUERIES


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist") and not isinstance(x, str):
        x = x.tolist()
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return None if x != x else round(float(x), 6) + 0.0
    return x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str([plain(x) for x in r]) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf, duck):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
