"""Every registered query with a SQL twin gives the rows of the twin, at the smallest scale."""

import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(TWINS[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in res.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - {n for n in QUERIES if re.match("p[1-7]_", n)}))  # those of the training data have tests of their own
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 20
