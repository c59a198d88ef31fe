"""Registered queries against the second engine on the smallest tables."""

import os

import pytest

from checks.compare import database, difference
from checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"
NAMES = list(REGISTRY)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, SF)
    if sql is None:
        assert df.columns
        df.count()
    else:
        assert difference(df, database(SF), sql) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["project_id", "critical", "medium", "low", "score", "passed"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
