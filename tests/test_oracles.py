"""Every query with SQL against DuckDB, on the small scale factor."""

from pathlib import Path

import duckdb
import pytest

from harborlight.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(x):
    if x is None:
        return "~"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if isinstance(x, float):
        return repr(round(x, 6)) if x != int(x) else str(int(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    mine = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    place = {d[0]: i for i, d in enumerate(want.description)}
    theirs = sorted(tuple(cell(r[place[c]]) for c in columns) for r in want.fetchall())
    assert mine == theirs
