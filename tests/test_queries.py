"""Every query against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from utterscope.plans import oracles, queries, roundtrips, streams

ORACLES = {**oracles.ORACLES, **roundtrips.ORACLES, **streams.ORACLES}
QUERIES = {**queries.QUERIES, **roundtrips.QUERIES, **streams.QUERIES}

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        c.sql(f"create view {path.stem} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_frames_are_numbered_over_ranges(spark, duck, monkeypatch):
    monkeypatch.setattr(queries, "RANGE", 64)
    got = QUERIES["level_windows"](spark, str(DATA))
    want = duck.sql(ORACLES["level_windows"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
