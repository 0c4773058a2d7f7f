"""Queries with an SQL twin give the twin's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cloudloom.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.sql(Q.ORACLE[name]).df()
    assert sorted(map(tuple, got[sorted(got.columns)].values.tolist())) == sorted(map(tuple, want[sorted(want.columns)].values.tolist()))


def test_mix_is_in_order(spark):
    at = [r.position for r in Q.p7_mix(spark, DATA).collect()]
    assert at and at == sorted(at)
