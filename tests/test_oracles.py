"""Every query with SQL gives the same rows in Spark and DuckDB."""

import pytest

from tallyforge.plans import registry
from tests.conftest import DATA, rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    ours = rows(registry.QUERIES[name](spark, DATA).toPandas())
    theirs = rows(duck.execute(registry.ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
