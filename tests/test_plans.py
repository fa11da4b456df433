"""What the optimizer makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import forecasts, indicators, learning, selection, trends
from tidemark.operators import reversals as rev


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, price_table):
    path = str(tmp_path_factory.mktemp("bars") / "p")
    price_table(_00001=range(1, 200), _00002=range(50, 300)).write.parquet(path)
    return spark.read.parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"- (?:Broadcast)?Exchange", plan(df)))


@pytest.mark.parametrize("make", [
    indicators.moving_averages, indicators.ema, indicators.basic_features, trends.indicators,
    lambda df: forecasts.predict_stock(df, ensembles=False), trends.current_trend])
def test_one_shuffle(stored, make):
    assert exchanges(make(stored)) == 1


def test_no_python_and_no_product_of_rows(stored):
    for df in (trends.indicators(stored), forecasts.predict_stock(stored, ensembles=True),
               forecasts.trend_summary(stored), rev.all_reversals(stored)):
        text = plan(df)
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text


def test_filters_and_columns_reach_the_scan(stored):
    df = selection.date_filter(stored, "2020-02-01", "2020-03-01")
    text = plan(indicators.moving_averages(df).select(CODE, "date", "ma_5"))
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in text
    assert re.search(r"ReadSchema: struct<stock_code:string,date:date,open:double,high:double,low:double,close:double,volume:double>", text)


def test_counts_are_combined_before_the_shuffle(stored):
    for df in (selection.points_per_stock(stored), selection.median_above(stored, 1),
               selection.median_volume(stored), selection.latest_row(stored)):
        assert "partial_" in plan(df)


def test_ensemble_moves_only_the_end_of_a_series(stored):
    from tidemark.operators.ensembles import ensemble_trend
    text = plan(ensemble_trend(stored))
    assert re.search(r"WindowGroupLimit .*row_number\(\), 51, Partial", text)
    assert exchanges(ensemble_trend(stored)) == 1


def test_models_are_known():
    assert [learning.MODELS[m][0] in learning.LABELS for m in learning.MODELS] == [True] * 5


def test_fallbacks_move_only_the_end_of_a_series(stored):
    for made in (forecasts.fallback_trend(stored), forecasts.fallback_reversal(stored)):
        assert re.search(r"WindowGroupLimit .*row_number\(\), 51, Partial", plan(made))
        assert exchanges(made) == 1


def test_both_kinds_of_reversals_share_one_profile(stored):
    one = plan(forecasts.next_reversal(stored, "short")).count("RunningWindowFunction") + plan(
        forecasts.next_reversal(stored, "short")).count("Window [")
    both = plan(forecasts.next_reversals(stored)).count("RunningWindowFunction") + plan(
        forecasts.next_reversals(stored)).count("Window [")
    assert both < 2 * one


def test_repeated_dates_do_not_depend_on_the_order_of_the_input(spark):
    rows = [("a", f"2025-01-{1 + i // 3:02d}", float(10 + i * 7 % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "stock_code string, d string, close double").selectExpr(
        "stock_code", "cast(d as date) as date", "close")
    told = [sorted((r.date, r.close, r.ma_5) for r in indicators.moving_averages(x).select("date", "close", "ma_5").fillna(-1).collect())
            for x in (df, df.orderBy("close"), df.repartition(7))]
    assert told[0] == told[1] == told[2]


def test_narrow_slabs_are_refused(spark, price_table):
    from tidemark.functions.series import lay_out
    from tidemark.params import TrendParams
    wide = TrendParams(short_window=10, long_window=100, lookback=120)
    cut = lay_out(price_table(_00001=range(1, 200)), 1100)
    with pytest.raises(ValueError, match="margins"):
        indicators.ema(cut, wide)
    assert indicators.ema(lay_out(price_table(_00001=range(1, 200)), 4000, p=wide), wide).count() == 199


def test_gaps_inside_a_series_leave_windows_empty(spark, price_table):
    df = price_table(_00001=range(1, 60)).withColumn("volume", F.when(F.dayofyear("date") % 7 != 0, 100.0))
    known = {r.volume_ma_5 for r in indicators.volume_features(df).collect()}
    assert known == {None, 100.0}


def test_rows_of_a_task_do_not_grow_with_the_bars(spark, tmp_path, monkeypatch):
    from tidemark.plans import fixtures, registry
    rows = spark.range(4000).selectExpr("id as l_orderkey", "id % 7 as l_partkey", "id % 40 as l_suppkey", "1 as l_linenumber", "2.0D as l_quantity",
                                        "id + 10.0D as l_extendedprice", "timestamp'1995-01-01' + make_interval(0, 0, 0, cast(id div 40 as int)) as l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    plan = registry.QUERIES["ema_wide"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(stock_code") == 1 and "REPARTITION_BY_NUM" in plan and ", 40)" in plan
