"""Every registered query runs, and equals its SQL twin, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["area_id", "lat_bucket", "lon_bucket", "fires", "percentage", "nearest_place"] and df.count() >= 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert got == sorted(repr(tuple(map(plain, r))) for r in want)
