import pytest

from loomtext.plans import registry

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    compare(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
