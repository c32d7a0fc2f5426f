"""Every registered query runs; those with an oracle match DuckDB over the same whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows as sorted text, columns by name, numbers by value."""

    def cell(v):
        if isinstance(v, list):
            return str([cell(x) for x in v])
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(float(v))
        return str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical(df.columns, got) == canonical(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
