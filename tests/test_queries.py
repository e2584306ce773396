"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
SLOW = {"sink_event_store"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLES:
        result = db.sql(ORACLES[name])
        assert columns == sorted(result.columns)
        places = [result.columns.index(c) for c in columns]
        assert mine == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
