"""The driver's contract."""

import __spark_entry__ as entry
from mapweave.plans.catalogue import ORACLES, QUERIES


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert len(ORACLES) > 40
