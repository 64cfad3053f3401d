"""Every catalog query against its DuckDB SQL."""

import pytest
from parity import connection, differences

import lattica.operators  # noqa: F401
from lattica import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert name in plans.ORACLES, "every catalog query has SQL"
    assert differences(spark, con, SF, plans.QUERIES[name], plans.ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
