"""Every query with an oracle gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from mapweave.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def views(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, views, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    expected = views.sql(ORACLES[name])
    names = list(expected.columns)
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in expected.fetchall())
