"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) if math.isfinite(value) else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = lambda rs, at: sorted(tuple(str(plain(r[i])) for i in at) for r in rs)
    assert rows(df.select(*columns).collect(), range(len(columns))) == rows(found.fetchall(), [names.index(c) for c in columns])


def test_entry(spark):
    assert {r[0]: r[1] for r in entry.entry(spark).collect()}.keys() <= {"changed", "failed", "unchanged", None}
