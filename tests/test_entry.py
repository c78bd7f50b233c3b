import pytest
from oracle import connect, same

import __spark_entry__
from tidemark import queries as core

SF = "/root/testdata/sf0.001"
ORACLES = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0
