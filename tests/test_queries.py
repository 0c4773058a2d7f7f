"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import glob
import importlib
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [m for m in entry._CORE]
CASES = [(m, q) for m in CORE for q in importlib.import_module(m).ORACLE]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> Counter:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return None
        return float(v) + 0.0 if isinstance(v, (float, np.floating, int, np.integer)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("module,name", CASES)
def test_same_as_sql(spark, duck, module, name):
    m = importlib.import_module(module)
    got = m.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(m.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["y", "x", "r", "g", "b", "alpha"] and out.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
