"""The corpus queries that SQL can express give the rows of their SQL."""

import pytest

from mapweave.llm.queries import ORACLES, QUERIES

from ..test_oracles import plain, views  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, views, name):  # noqa: F811
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    expected = views.sql(ORACLES[name])
    names = list(expected.columns)
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in expected.fetchall())
