"""Every registered query of the library against DuckDB on the smallest tables."""

import pytest

from compare import duck_rows, spark_rows
from tideframe import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    assert name in plans.ORACLES
    assert spark_rows(plans.QUERIES[name](spark, SF)) == duck_rows(plans.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
