"""The registered queries: every one runs, and those that SQL can express agree with it."""

from pathlib import Path

import pytest

from __spark_entry__ import queries
from compare import compare, connect
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) == ""


def test_queries_are_registered():
    registered = queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)
    assert [sum(n.startswith(f"op{i}_") for n in registered) for i in range(1, 14)] == [1] * 13
