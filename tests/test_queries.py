"""Every query with SQL gives the rows that DuckDB gives, on the smallest driver tables."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tabspark.plans import coverage, problems

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = {**coverage.QUERIES, **problems.QUERIES}, {**coverage.ORACLES, **problems.ORACLES}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as from '{path}'")
    return connection


def plain(x):
    if isinstance(x, (float, Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (dt.datetime, dt.date)):
        return str(x)
    return repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())


def test_driver_contract(spark):
    queries, oracles = driver.queries(), driver.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    assert driver.entry(spark).columns == ["mean_ratio", "n"]
