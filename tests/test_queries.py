"""Every named query against its SQL in DuckDB; queries without SQL must give rows."""

import oracle
import pytest

from fraudspark.plans import catalog, registry

catalog.load()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, folder, name):
    df = registry.QUERIES[name](spark, folder)
    if name in registry.CHECKS:
        assert oracle.compare(df, con, registry.CHECKS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
