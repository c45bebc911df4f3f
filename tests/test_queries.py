import pytest

from splitfold.staged_queries import ORACLE, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_duckdb(name, spark, sf_dir):
    assert_same(QUERIES[name], ORACLE[name], spark, sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
