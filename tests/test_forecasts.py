"""Forecast formulas against a plain model of them, short histories above all."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import ensembles, forecasts
from tidemark.operators import reversals as rev
from tidemark.operators import trends
from tidemark.params import TrendParams

P = TrendParams(trend_threshold=0.5)
SIZES = (4, 5, 6, 19, 20, 21, 24, 25, 26, 27, 29, 34, 35, 59, 60, 69, 70, 99, 100, 180)
RNG = np.random.default_rng(11)
SERIES = {f"{n:05d}": (100 + RNG.normal(0, 2, n).cumsum()).round(3).tolist() for n in SIZES}
SERIES["flat"] = [50.0] * 80
SERIES["one"] = [10.0]


@pytest.fixture(scope="module")
def table(price_table):
    return price_table(**SERIES).cache()


def call(slope, t):
    return "+" if slope > t else "-" if slope < -t else "0"


def fitted(closes, window, rows):
    ma = pd.Series(closes).rolling(window).mean().dropna().tail(rows)
    if len(closes) < window or len(ma) < 2:
        return "0"
    return call(np.polyfit(range(len(ma)), ma.values, 1)[0], P.trend_threshold)


def plain_trend(closes, window):
    if len(closes) < window:
        return "0", 0.3, "insufficient_data"
    ma = pd.Series(closes).rolling(window).mean().dropna().tail(3).tolist()
    if len(ma) < 2:
        return "0", 0.3, "insufficient_ma"
    slope = (ma[-1] - ma[0]) / len(ma)
    return (call(slope, P.trend_threshold), min(abs(slope) / P.trend_threshold, 1) * 0.7,
            "fallback_analysis")


def plain_reversal(closes, window):
    r = pd.Series(closes).pct_change().dropna()
    if len(r) < window:
        return closes[-1], 0.3
    side = -1 if plain_trend(closes, window)[0] == "-" else 1
    return closes[-1] * (1 + side * r.tail(2 * window).std()), 0.5


def plain_confidence(closes, kind):
    s, n = pd.Series(closes), len(closes)
    factors = [1.0 if n >= 35 else 0.7 if n >= 5 else 0.3]
    if n >= 20:
        recent, whole = s.pct_change().tail(20).std(), s.pct_change().std()
        factors.append(max(0.3, 1 - (recent / whole - 1) * 0.5) if whole > 0 else 0.7)
    w = P.window(kind)
    moves = s.tail(w if n >= w else min(10, n)).diff().dropna()
    if len(moves):
        factors.append(max((moves > 0).sum(), (moves < 0).sum()) / len(moves))
    return min(max(50 * np.mean(factors), 0), 100)


def test_basic_forecasts(table):
    for r in forecasts.predict_stock(table, P).collect():
        closes = SERIES[r[CODE]]
        for kind in ("short", "long"):
            w = P.window(kind)
            trend, _, method = plain_trend(closes, w)
            assert (r[f"{kind}_trend"], r.prediction_methods[f"{kind}_trend_method"]) == (trend, method)
            price, _ = plain_reversal(closes, w)
            assert r[f"{kind}_reversal_price"] == pytest.approx(price, rel=1e-9), (r[CODE], kind)
            assert r[f"{kind}_confidence"] == pytest.approx(plain_confidence(closes, kind), rel=1e-9)
        assert r.data_quality.data_points == len(closes)
        assert r.current_price == closes[-1]


def test_fallback_confidences(table):
    t = {r[CODE]: r for r in forecasts.fallback_trend(table, P).collect()}
    v = {r[CODE]: r for r in forecasts.fallback_reversal(table, P).collect()}
    for code, closes in SERIES.items():
        assert t[code].long_trend_confidence == pytest.approx(plain_trend(closes, 25)[1])
        assert v[code].short_reversal_confidence == plain_reversal(closes, 5)[1]


def test_current_trend(table):
    for r in trends.current_trend(table, P).collect():
        closes = SERIES[r[CODE]]
        assert (r.short_trend, r.long_trend) == (fitted(closes, 5, 3), fitted(closes, 25, 5)), r[CODE]


@pytest.mark.parametrize("kind", ["short", "long"])
def test_next_reversal(table, kind):
    """From the found reversals on, the expected price and its confidence."""
    w, rows = P.window(kind), P.slope_rows(kind)
    found = {}
    for r in rev.reversals(table, kind, P).orderBy(CODE, "idx").collect():
        found.setdefault(r[CODE], []).append(r)
    for r in forecasts.next_reversal(table, kind, P).collect():
        closes, mine = SERIES[r[CODE]], found.get(r[CODE], [])
        if len(mine) < 2:
            assert (r.price, r.confidence, r.type, r.current_trend) == (closes[-1], 0.0, "unknown", None)
            continue
        trend = fitted(closes, w, rows)
        last = mine[-5:]
        size = np.mean([abs(b.price - a.price) for a, b in zip(last, last[1:])])
        want = {"+": closes[-1] + size / 2, "-": closes[-1] - size / 2, "0": mine[-1].price}[trend]
        assert r.price == pytest.approx(want) and r.current_trend == trend
        if len(mine) < 3:
            assert r.confidence == 0.3
            continue
        gaps = [(b.date - a.date).days for a, b in zip(mine, mine[1:])]
        factors = [max(0, 1 - np.std(gaps) / max(np.mean(gaps), 1))]
        past = [fitted(closes[:i + 1], w, rows) for i in range(len(closes) - w, len(closes))]
        factors.append(max(0, 1 - sum(a != b for a, b in zip(past, past[1:])) / w))
        pv = pd.Series(closes).rolling(20).std()
        if pv.mean() > 0:
            factors.append(max(0, 1 - pv.tail(20).mean() / pv.mean()))
        assert r.confidence == pytest.approx(np.mean(factors), rel=1e-9), r[CODE]


def test_errors_and_summary(table, spark):
    codes = spark.createDataFrame([("00180",), ("00100",), ("00020",), ("gone",)], "stock_code string")
    out = forecasts.batch_predict(table, codes, P)
    told = {r[CODE]: r for r in out.collect()}
    assert told["gone"].error == "no price data" and told["00020"].error == "insufficient data"
    assert told["00020"].current_price is None and told["00180"].error is None
    s = forecasts.prediction_summary(out).first()
    assert (s.total_stocks, s.successful_predictions, s.failed_predictions) == (4, 2, 2)
    kept = [told["00180"], told["00100"]]
    assert s.long_confidence_std == pytest.approx(np.std([r.long_confidence for r in kept]))
    assert s.short_avg_change == pytest.approx(np.mean(
        [r.short_reversal_price / r.current_price - 1 for r in kept]))


def test_rating_rules(spark):
    df = spark.createDataFrame([(0.6, 0.06), (0.001, 0.005), (0.2, 0.02)], "change double, spread double")
    got = [r[0] for r in df.select(forecasts.adjust_reversal_confidence(
        F.lit(0.5), F.col("change"), F.col("spread"))).collect()]
    assert got == pytest.approx([0.5 * 0.7 * 0.9, 0.5 * 0.8 * 1.1, 0.5])
    df = spark.createDataFrame([(-0.9,), (3.0,), (0.1,)], "change double")
    got = [r[0] for r in df.select(forecasts.clamp_reversal_price(F.lit(100.0), F.col("change"))).collect()]
    assert got == pytest.approx([50, 200, 110])


def test_ensembles(table):
    a = ensembles.ensemble_trend(table, P).orderBy(CODE).collect()
    assert a == ensembles.ensemble_trend(table.repartition(3), P).orderBy(CODE).collect()
    sure = {r[CODE]: r for r in ensembles.ensemble_reversal(table, P).collect()}
    assert sure["00004"].short_price_std == 0.0  # too short a series is not disturbed
    assert sure["00180"].short_price_std > 0
    noise = ensembles.members(table.where("stock_code = '00180'"), P).select(
        (F.col("close") / F.avg("close").over(Window.partitionBy("date")) - 1)
        .alias("e")).toPandas()["e"]
    assert 0.0005 < noise.std() < 0.0015 and not any(math.isnan(x) for x in noise)


def test_analyzer_path(table):
    one = {r[CODE]: r for r in forecasts.predict_stock(table, P, method="analyzer").collect()}
    two = {r[CODE]: r for r in forecasts.next_reversal(table, "long", P).collect()}
    assert all(one[c].long_reversal_price == two[c].price for c in one)
    with pytest.raises(ValueError):
        forecasts.predict_stock(table, P, method="other")


def test_indicators_of_the_last_rows(spark, price_table):
    """They are those of whole series, though windows see only the rows that these look back at."""
    import math

    from tidemark.functions.series import CODE
    from tidemark.operators.trends import indicators
    wave = [100 + 7 * math.sin(i / 3) + i % 11 for i in range(400)]
    prices = price_table(_00001=wave, _00002=wave[:130:-1], _00003=wave[:40])
    whole = {(r[CODE], r.date): r.asDict() for r in indicators(prices).collect()}
    ends = indicators(prices, last=60).collect()
    assert sorted((r[CODE], r.pos) for r in ends) == sorted(
        (c, i) for c, n in (("00001", 400), ("00002", 269), ("00003", 40)) for i in range(max(0, n - 60), n))
    for r in ends:
        for c, x in whole[r[CODE], r.date].items():
            assert r[c] == x if not isinstance(x, float) else abs(r[c] - x) < 1e-9, c
    assert "(n#" in indicators(prices, last=60)._jdf.queryExecution().executedPlan().toString()
