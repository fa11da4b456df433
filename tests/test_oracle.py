"""Every registered query with SQL, at the smallest scale, against that SQL."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, queries()[name], oracle_sql()[name]) == ""


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark).collect()
    # ten codes with prices, and as many unknown ones as there are nations
    assert len(out) == 35 and sum(r.voted_trend is not None for r in out) == sum(r.error is None for r in out) > 0
