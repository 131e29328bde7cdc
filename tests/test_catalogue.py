"""Every registered query with SQL gives the same rows as DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lexloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v) if v is not None and not isinstance(v, (int, float, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql()[name]
    found = duck.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())
