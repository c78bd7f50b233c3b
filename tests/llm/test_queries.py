import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import connect, same  # noqa: E402

import __spark_entry__  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    if name in Q.oracle_sql():
        same(df, connect(SF), Q.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
