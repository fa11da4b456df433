import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ewm import Ewm, ewm, macd
from tidemark.functions.series import (CODE, last_rows, lay_out, place, settle, series_window,
                                       slope_of_last, with_position)
from tidemark.operators import indicators as ind
from tidemark.operators import trends

RNG = np.random.default_rng(7)
WALK = (1000 + RNG.normal(0, 5, 2500).cumsum()).round(2)


def column(df, c, order="date"):
    return [r[c] for r in df.orderBy(CODE, order).select(c).collect()]


def close_to(got, want, tol=1e-9):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        if b is None or (isinstance(b, float) and np.isnan(b)):
            assert a is None
        else:
            assert a == pytest.approx(b, rel=tol, abs=tol)


@pytest.mark.parametrize("span", [2, 5, 25, 26])
@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_recursion(price_table, span, adjust):
    df = ewm(price_table(_00001=WALK), {"x": Ewm("close", span, adjust)})
    close_to(column(df, "x"), list(pd.Series(WALK).ewm(span=span, adjust=adjust).mean()), 1e-12)


@pytest.mark.parametrize("adjust", [True, False])
def test_macd_signal_over_mixed_signs(price_table, adjust):
    s = pd.Series(WALK)
    line = s.ewm(span=12, adjust=adjust).mean() - s.ewm(span=26, adjust=adjust).mean()
    df = macd(price_table(_00001=WALK), adjust=adjust)
    close_to(column(df, "macd"), list(line), 1e-9)
    close_to(column(df, "macd_signal"), list(line.ewm(span=9, adjust=adjust).mean()), 1e-9)


def test_warm_up_rows(price_table):
    df = trends.indicators(price_table(_00001=WALK[:120]))
    first = {"ma_5": 4, "ma_25": 24, "short_trend_slope": 6, "long_trend_slope": 28,
             "short_trend_consistency": 9, "long_trend_consistency": 19, "price_volatility": 19,
             "volatility_5d": 5, "volatility_20d": 20, "volatility_ratio": 68,
             "ma_long_volatility": 43, "roc_25": 25}
    rows = df.orderBy("date").collect()
    for c, at in first.items():
        assert [r[c] is None for r in rows] == [True] * at + [False] * (120 - at), c
    bare = ind.rsi(price_table(_00001=WALK[:30]), fill=None)
    assert [x is None for x in column(bare, "rsi")] == [True] * 13 + [False] * 17


def test_windows_equal_pandas(price_table):
    s = pd.Series(WALK[:300])
    df = ind.volatility_features(ind.bollinger(ind.volatility(ind.moving_averages(
        price_table(_00001=WALK[:300])))))
    r = s.pct_change()
    close_to(column(df, "ma_50"), list(s.rolling(50).mean()))
    close_to(column(df, "volatility_20d"), list(r.rolling(20).std()), 1e-7)
    close_to(column(df, "bb_upper"), list(s.rolling(20).mean() + 2 * s.rolling(20).std()), 1e-8)
    pv = s.rolling(20).std()
    close_to(column(df, "volatility_ratio"), list(pv / pv.rolling(50).mean()), 1e-7)


def test_flat_up_and_down(price_table):
    up = [100.0 + i for i in range(80)]
    df = trends.indicators(price_table(_00001=[100.0] * 80, _00002=up, _00003=up[::-1]))
    last = {r[CODE]: r for r in df.where("date = '2020-03-20'").collect()}
    assert [last[c]["rsi"] for c in sorted(last)] == [50.0, 100.0, 0.0]
    assert [last[c]["short_trend"] for c in sorted(last)] == ["0", "+", "-"]
    assert [last[c]["long_trend"] for c in sorted(last)] == ["0", "+", "-"]
    assert [last[c]["trend_agreement"] for c in sorted(last)] == [0, 1, 1]
    assert last["00001"]["volatility_ratio"] is None  # 0 / 0 is missing, not an error
    band = ind.bollinger(price_table(_00001=[100.0] * 25)).where("bb_upper is not null")
    assert band.where("bb_upper <> bb_lower").count() == 0


def test_zero_volume_is_missing_not_an_error(price_table):
    df = price_table(_00001=WALK[:60]).withColumn("volume", F.lit(0.0))
    assert ind.volume_features(df).where("volume_ratio is not null").count() == 0
    assert ind.basic_features(df).count() == 0


def test_nothing_crosses_codes(price_table):
    one = trends.indicators(price_table(_00002=WALK[:70])).drop(CODE).orderBy("date").collect()
    two = trends.indicators(price_table(_00001=WALK[70:140], _00002=WALK[:70]))
    assert two.where("stock_code = '00002'").drop(CODE).orderBy("date").collect() == one


def test_a_later_row_changes_no_earlier_one(price_table):
    short = trends.indicators(price_table(_00001=WALK[:90])).orderBy("date").collect()
    longer = trends.indicators(price_table(_00001=WALK[:91])).orderBy("date").limit(90).collect()
    assert short == longer


def test_slope_is_least_squares(price_table):
    df = price_table(_00001=WALK[:10])
    df = df.withColumn("s", slope_of_last(F.col("close"), series_window(df), 5, at_least=2))
    want = [None] + [np.polyfit(range(min(i + 1, 5)), WALK[max(0, i - 4):i + 1], 1)[0]
                     for i in range(1, 10)]
    close_to(column(df, "s"), want, 1e-9)


@pytest.fixture(scope="module")
def crowded(spark, price_schema):
    """A third of all rows belongs to one code and its dates repeat."""
    rows = []
    for code, n in [("00001", 3000)] + [(f"{i:05d}", 300) for i in range(2, 22)]:
        for i in range(n):
            c = float(WALK[(i * 7 + int(code)) % 2500])
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 4)
            rows.append((code, day, c, c + 1, c - 1, c, float(i % 13)))
    return spark.createDataFrame(rows, price_schema)


def test_place_equals_a_full_sort(crowded):
    got = place(crowded).toPandas()
    keys = [CODE, "date", "open", "high", "low", "close", "volume"]
    want = crowded.toPandas().sort_values(keys).reset_index(drop=True)
    want["pos"] = want.groupby(CODE).cumcount()
    got = got.sort_values([CODE, "pos"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[keys + ["pos"]], want[keys + ["pos"]], check_dtype=False)
    assert (got["n"] == got.groupby(CODE)["pos"].transform("size")).all()


def test_slabs_are_bounded_and_keep_every_row(crowded):
    cut = lay_out(crowded, rows_per_slab=1100)
    assert cut.groupBy(CODE, "slab").count().agg(F.max("count")).first()[0] <= 1100 + 1024 + 64
    assert cut.where(F.col(CODE) == "00001").select("slab").distinct().count() == 3
    assert settle(cut).count() == crowded.count()
    plan = cut.withColumn("x", F.lag("close").over(series_window(cut)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(stock_code" in text and "slab" in text.split("Exchange")[1].split("\n")[0]


def test_results_do_not_depend_on_the_cut(crowded):
    p = ["pos", "ma_50", "ema_25", "macd_signal", "volatility_ratio", "long_trend_slope",
         "long_trend_consistency", "roc_25"]
    made = [settle(trends.indicators(lay_out(crowded, rows_per_slab=b))).select(CODE, *p)
            .toPandas().sort_values([CODE, "pos"]).reset_index(drop=True) for b in (1100, 100000)]
    pd.testing.assert_frame_equal(*made, rtol=1e-9)


def test_intraday_timestamps(spark):
    start = datetime.datetime(2024, 1, 2, 9, 0)
    rows = [("00001", start + datetime.timedelta(minutes=i * 7), float(WALK[i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "stock_code string, date timestamp_ntz, close double")
    out = settle(ind.moving_averages(lay_out(df, rows_per_slab=1100)))
    close_to(column(out, "ma_25", "pos"), list(pd.Series(WALK[:2000]).rolling(25).mean()))


def test_last_rows_are_cut_before_the_shuffle(price_table):
    df = last_rows(price_table(_00001=WALK[:50], _00002=WALK[:3]), 5)
    assert df.count() == 8
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_position_counts_rows(price_table):
    df = with_position(price_table(_00001=WALK[:4]))
    assert [(r.pos, r.n) for r in df.orderBy("date").collect()] == [(i, 4) for i in range(4)]


def test_margins_are_left_out_where_only_own_rows_are_asked_for(crowded):
    """The same indicators of the rows of each slab, from less than its two margins."""
    cut = lay_out(crowded, rows_per_slab=1100)
    key = lambda df: df.toPandas().sort_values([CODE, "pos"]).reset_index(drop=True)
    own = trends.indicators(cut, own=True)
    pd.testing.assert_frame_equal(key(settle(own)), key(settle(trends.indicators(cut))), rtol=1e-9)
    assert own.groupBy(CODE, "slab").count().agg(F.max("count")).first()[0] <= 1100 + 120
    daily = crowded.dropDuplicates([CODE, "date"])
    assert trends.indicators(daily, own=True).count() == daily.count()
