"""Every query with SQL against DuckDB on the smallest tables; the others run and have a stable schema."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import rows

SF = "/root/testdata/sf0.001"
CORE = {n: q for n, q in entry.queries().items() if n[:2] not in ("p6", "p7", "p8")}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(n for n in CORE if n in entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = CORE[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in CORE if n not in entry.oracle_sql()))
def test_runs_with_a_stable_schema(spark, name):
    df = CORE[name](spark, SF)
    assert df.count() > 0 and df.schema == CORE[name](spark, SF).schema
