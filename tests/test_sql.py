"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import pytest

from loomrow import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    why, _ = compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert why is None, why


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["tx", "node", "n_local", "n_remote"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
