"""Every query with a SQL counterpart gives its rows."""

import glob
import math
import os

import duckdb
import pytest

from lexweave.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert len(set(names)) == len(names)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in ORACLE_SQL:
        rel = con.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == names
        at = [rel.columns.index(c) for c in names]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
