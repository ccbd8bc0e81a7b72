"""Every registered query against its SQL."""

import pytest
from tests.conftest import SF, same

from granary.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(name, spark, duck):
    same(registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
