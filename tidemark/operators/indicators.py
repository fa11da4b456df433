"""Trailing indicators. Each operator takes a price table and adds columns to it.

All of them run on the one window of the series (see ``functions.series``), so a chain of
them shuffles once and Catalyst drops the columns a query does not ask for. Missing values
are NULL, never NaN: in Spark a NaN compares greater than any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import Ewm, ewm, macd
from ..functions.series import (check_margins, full_window, prior, reaches_back, safe_ratio,
                                series_window, spread_rows, trailing)
from ..params import KINDS, TrendParams

DEFAULT = TrendParams()


def candle_columns() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "price_range": h - l,
        "body_size": F.abs(c - o),
        "upper_shadow": h - F.greatest(o, c),
        "lower_shadow": F.least(o, c) - l,
    }


def candle_features(prices: DataFrame) -> DataFrame:
    return prices.withColumns(candle_columns())


def change(x: str, w, rows: int = 1) -> Column:
    return safe_ratio(F.col(x), prior(x, w, rows)) - 1


def returns(prices: DataFrame) -> DataFrame:
    w = series_window(prices)
    return prices.withColumns({
        "return_1d": change("close", w),
        "return_1d_log": F.log(safe_ratio(F.col("close"), prior("close", w))),
    })


def with_return(df: DataFrame) -> DataFrame:
    if "return_1d" in df.columns:
        return df
    return df.withColumn("return_1d", change("close", series_window(df)))


def volatility(prices: DataFrame) -> DataFrame:
    df = with_return(prices)
    w, r = series_window(df), F.col("return_1d")
    return df.withColumns({
        f"volatility_{k}d": full_window(F.stddev_samp, r, w, k) for k in (5, 20)
    })


def moving_averages(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    w = series_window(prices)
    return prices.withColumns({
        f"ma_{k}": full_window(F.avg, F.col("close"), w, k)
        for k in (p.short_window, p.long_window, 10, 50)
    })


def ma_columns(df: DataFrame, p: TrendParams, kinds=KINDS) -> dict[str, Column]:
    """The averages of the two trends that the table does not have yet."""
    check_margins(df, spread_rows(p))
    w = series_window(df)
    return {f"ma_{k}": full_window(F.avg, F.col("close"), w, k)
            for k in map(p.window, kinds) if f"ma_{k}" not in df.columns}


def ensure_ma(df: DataFrame, p: TrendParams) -> DataFrame:
    return df.withColumns(ma_columns(df, p))


def ema(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return ewm(prices, {f"ema_{k}": Ewm("close", k, True)
                        for k in (p.short_window, p.long_window)})


def rsi(prices: DataFrame, window: int = 14, fill: float | None = 50.0) -> DataFrame:
    """Simple-mean RSI. The first row counts as a day without change; where neither gains
    nor losses exist, or the window is not full, the value is ``fill``."""
    w = series_window(prices)
    df = prices.withColumn("_delta", F.col("close") - prior("close", w))
    d, frame = F.col("_delta"), trailing(w, window)
    gain = F.sum(F.when(d > 0, d).otherwise(0.0)).over(frame) / F.lit(float(window))
    loss = F.sum(F.when(d < 0, -d).otherwise(0.0)).over(frame) / F.lit(float(window))
    full = reaches_back(w, window)
    value = (F.when(full & (loss > 0), 100 - 100 / (1 + gain / F.when(loss > 0, loss)))
             .when(full & (gain > 0), 100.0))
    if fill is not None:
        value = value.otherwise(fill)
    return df.withColumn("rsi", value).drop("_delta")


def bollinger(prices: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    w, c = series_window(prices), F.col("close")
    mid = full_window(F.avg, c, w, window)
    spread = full_window(F.stddev_samp, c, w, window) * F.lit(width)
    return prices.withColumns({"bb_upper": mid + spread, "bb_lower": mid - spread})


def volume_features(prices: DataFrame) -> DataFrame:
    w = series_window(prices)
    df = prices.withColumn("volume_ma_5", full_window(F.avg, F.col("volume"), w, 5))
    return df.withColumn("volume_ratio", safe_ratio(F.col("volume"), F.col("volume_ma_5")))


def volatility_features(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    df = ensure_ma(prices, p)
    w, k = series_window(df), p.volatility_window
    spread = lambda c: full_window(F.stddev_samp, F.col(c), w, k)
    df = df.withColumns({
        "price_volatility": spread("close"),
        "ma_short_volatility": spread(f"ma_{p.short_window}"),
        "ma_long_volatility": spread(f"ma_{p.long_window}"),
    })
    usual = full_window(F.avg, F.col("price_volatility"), w, 50)
    return df.withColumn("_usual", usual).withColumn(
        "volatility_ratio", safe_ratio(F.col("price_volatility"), F.col("_usual"))
    ).drop("_usual")


def momentum(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    df = ensure_ma(prices, p)
    w = series_window(df)
    short, long = F.col(f"ma_{p.short_window}"), F.col(f"ma_{p.long_window}")
    return df.withColumns({
        "roc_5": change("close", w, 5),
        "roc_25": change("close", w, 25),
        "ma_convergence": short - long,
        "ma_convergence_pct": (safe_ratio(short, long) - 1) * 100,
    })


def basic_features(prices: DataFrame) -> DataFrame:
    """Candles, returns, volatility, volume, RSI without fill, Bollinger bands and the
    normalised MACD; rows with any of them missing are dropped."""
    df = macd(prices, adjust=True)
    df = volume_features(bollinger(rsi(volatility(returns(candle_features(df))), fill=None)))
    made = [c for c in df.columns if c not in prices.columns]
    return df.dropna(subset=[c for c in ("open", "high", "low", "close", "volume")] + made)
