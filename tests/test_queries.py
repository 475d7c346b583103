"""Every registered query over the smallest tables, against its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

from tracklake.plans.evidence_oracles import SQL as EVIDENCE_SQL
from tracklake.plans.oracles import SQL as OWN_SQL
from tracklake.plans.more_queries import QUERIES


SQL = OWN_SQL | EVIDENCE_SQL


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    return round(float(v), 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    got = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(got, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
