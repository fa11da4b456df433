"""Rows of a task do not grow with the table, and copies of a series stay with it."""

import hashlib
import math
import re

import numpy as np
import pytest

from tidemark.functions.series import CODE, TASK_ROWS, lay_out, parts_of
from tidemark.operators import ensembles, learning
from tidemark.operators.forecasts import analyzer_answers
from tidemark.params import LearnParams, TrendParams

P = TrendParams(trend_threshold=0.2)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prices(price_table):
    rng = np.random.default_rng(5)
    made = {f"_{i:05d}": (100 + rng.normal(0, 1, 140 + i).cumsum()).round(2).tolist() for i in range(5)}
    return price_table(**made)


def test_parts_grow_with_the_rows():
    assert parts_of(0, 4) == 4 and parts_of(5 * TASK_ROWS, 4) == 5 and parts_of(5 * TASK_ROWS + 1, 4) == 6


def test_slabs_lie_in_parts_by_rows(prices):
    """Twice the rows lie in slabs, about: 6 times the rows of a task ask for 12 parts, not fewer."""
    cut = lay_out(prices, rows_per_slab=1100, rows=6 * TASK_ROWS)
    assert ", 12), REPARTITION_BY_NUM" in plan(cut)
    assert cut.where("home").count() == prices.count()


def test_feature_rows_lie_in_buckets_by_rows(prices):
    l = LearnParams(lookback=3, fit_rows=60)
    data, plain = learning.prepare_learning(prices, P, l=l, rows=6 * TASK_ROWS), learning.prepare_learning(prices, P, l=l)
    assert "out of 6" in plan(data.table.groupBy(CODE).count())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(data.table) == key(plain.table)
    files = [f for f in data.table.inputFiles() if "/learning-" in f]
    assert len(files) == len({f.rsplit("_", 1)[1].split(".")[0] for f in files}) <= 6  # one a bucket


def test_the_analyzer_knows_members(prices):
    """The copies are answered as series of their own would be, without a shuffle of their rows."""
    own = ensembles.member_predictions(prices, P, lambda df, p: analyzer_answers(df, p))
    beside = ensembles.member_predictions(prices, P, "analyzer")
    key = lambda df: sorted(map(str, df.select(CODE, "member", "short_trend", "long_trend", "short_reversal_price",
                                              "long_reversal_price", "long_reversal_confidence").collect()))
    assert key(own) == key(beside) and len(key(own)) == 5 * P.ensemble_size
    by_member = re.compile(r"hashpartitioning\(stock_code#\d+, member#")
    assert by_member.search(plan(beside)) and not by_member.search(plan(own))


def test_a_digest_is_made_once_for_each_copy_of_a_close(prices):
    """And the noise is the one that the code, date, member and column tell."""
    made = ensembles.members(prices, P, "analyzer").select(CODE, "date", "member", "close")
    assert plan(made).count("md5") == 1 and plan(made).count("date_format") == 1
    plain = {(r[CODE], r.date): r.close for r in prices.collect()}
    for r in made.where("date < '2020-01-20'").collect():
        digest = hashlib.md5(f"{r[CODE]}|{r.date}|{r.member}|close".encode()).hexdigest()
        a, b = (int(digest[:8], 16) + 1) / (2.0 ** 32 + 1), int(digest[8:16], 16) / 2.0 ** 32
        noise = math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)
        assert r.close == pytest.approx(plain[r[CODE], r.date] * (1 + ensembles.NOISE * noise))
