"""Every query with SQL against DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = table(df.columns, df.collect())
    cur = duck.execute(catalogue.SQL[name])
    expected = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
