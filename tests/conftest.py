import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import local_session  # noqa: E402

PRICES = "stock_code string, date date, open double, high double, low double, close double, volume double"
DAY0 = datetime.date(2020, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def price_schema():
    return PRICES


@pytest.fixture(scope="session")
def price_table(spark):
    def make(**closes):
        """A daily table from lists of closing prices per code."""
        rows = [(code.lstrip("_"), DAY0 + datetime.timedelta(days=i), float(c), float(c) * 1.01,
                 float(c) * 0.99, float(c), 100.0)
                for code, values in closes.items() for i, c in enumerate(values)]
        return spark.createDataFrame(rows, PRICES)
    return make
