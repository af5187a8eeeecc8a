"""Every registered query of the mirror against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidemark.fixtures import TABLES
from tidemark.plans.all import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return "NULL" if value is None else f"{float(value):.6g}" if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    data = cur.fetchall()
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
