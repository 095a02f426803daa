"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(keyed, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, str(DATA))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(contract.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.limit(1).count() == 1
    assert "selected" in df.columns
