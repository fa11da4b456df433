"""Slope, direction, strength and consistency of the two moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import Ewm, macd
from ..functions.series import (CODE, check_margins, prior, reaches_back, series_window, slab_rows,
                                slope_of_last, spread_rows, tail, trailing, with_position)
from ..params import KINDS, TrendParams
from .indicators import (DEFAULT, ensure_ma, momentum, moving_averages, rsi, volatility,
                         volatility_features)

CONSISTENCY_ROWS = {"short": 10, "long": 20}


def direction(slope: Column, threshold: float) -> Column:
    return F.when(slope > threshold, 1).when(slope < -threshold, -1).otherwise(0)


def symbol_of_slope(slope: Column, threshold: float) -> Column:
    return F.when(slope > threshold, "+").when(slope < -threshold, "-").otherwise("0")


def symbol(direction: Column) -> Column:
    return F.when(direction == 1, "+").when(direction == -1, "-").otherwise("0")


def trend_slopes(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    df = ensure_ma(prices, p)
    w = series_window(df)
    out = {}
    for kind in KINDS:
        ma = f"ma_{p.window(kind)}"
        out[f"{kind}_trend_slope"] = slope_of_last(F.col(ma), w, p.slope_rows(kind))
        out[f"{kind}_trend_slope_simple"] = F.col(ma) - prior(ma, w)
    return df.withColumns(out)


def trend_directions(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    df = prices if "short_trend_slope" in prices.columns else trend_slopes(prices, p)
    out = {}
    for kind in KINDS:
        d = direction(F.col(f"{kind}_trend_slope"), p.trend_threshold)
        out[f"{kind}_trend_direction"] = d
        out[f"{kind}_trend"] = symbol(d)
    return df.withColumns(out)


def trend_features(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    """Slopes, directions, strengths and whether both directions agree."""
    df = trend_directions(prices, p)
    both = F.col("short_trend_direction") * F.col("long_trend_direction")
    return df.withColumns({
        **{f"{k}_trend_strength": F.abs(F.col(f"{k}_trend_slope")) for k in KINDS},
        "trend_agreement": F.greatest(both, F.lit(0)),
    })


def trend_consistency(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    """Share of the last rows that point the way the current row does."""
    df = prices if "short_trend_direction" in prices.columns else trend_directions(prices, p)
    w = series_window(df)
    out = {}
    for kind, rows in CONSISTENCY_ROWS.items():
        d, frame = F.col(f"{kind}_trend_direction"), trailing(w, rows)
        balance, moving = F.sum(d).over(frame), F.sum(F.abs(d)).over(frame)
        alike = F.when(d == 0, rows - moving).otherwise((moving + d * balance) / 2)
        out[f"{kind}_trend_consistency"] = F.when(reaches_back(w, rows),
                                                  alike / F.lit(float(rows)))
    return df.withColumns(out)


def indicators(prices: DataFrame, p: TrendParams = DEFAULT, last: int | None = None,
               own: bool = False) -> DataFrame:
    """The full indicator set. The recursive averages come first because they sort the
    series by blocks; everything after them shares one order and one shuffle.

    With ``last``, for the last rows of each series only and with their ``pos`` and ``n``: the
    recursive averages see whole series, the windows only what those rows look back at. With ``own``,
    for the rows that a slab does not share: nothing looks ahead, only the recursive averages look at the
    whole margin behind, and the margins are of no use afterwards."""
    averages = {f"ema_{k}": Ewm("close", k, True) for k in (p.short_window, p.long_window)}
    near = lambda df, rows: df if last is None else df.where(F.col("n") - F.col("pos") <= rows)
    slabs = slab_rows(prices) if own else None
    start = F.col("slab") * F.lit(slabs)
    if slabs is not None:
        prices = prices.where(F.col("pos") < start + slabs)
    df = macd(prices if last is None else with_position(prices), also=averages)
    df = near(df, (last or 0) + spread_rows(p))
    if slabs is not None:
        check_margins(df, spread_rows(p))
        df = df.where(F.col("pos") >= start - spread_rows(p))
    df = rsi(volatility(moving_averages(df, p)))
    df = trend_consistency(trend_features(df, p), p)
    return near(momentum(volatility_features(df, p), p), last)


def trend_as_of(df: DataFrame, kind: str, p: TrendParams) -> Column:
    """What :func:`current_trend` would have said on each row."""
    y = F.col(f"ma_{p.window(kind)}")
    slope = slope_of_last(y, series_window(df), p.slope_rows(kind), at_least=2)
    return symbol_of_slope(slope, p.trend_threshold)


def current_trend(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    """Short and long trend of every code as of its last row.

    Only the rows the last slope can see leave the map side: the long window plus the
    values the slope is fitted on."""
    need = p.long_window + p.slope_rows("long") - 1
    end = ensure_ma(tail(prices, need).select(CODE, "date", "close", "pos", "n"), p)
    end = end.withColumns({f"{k}_trend": trend_as_of(end, k, p) for k in KINDS})
    return end.where("pos = n - 1").select(
        CODE, F.col("date").alias("analysis_date"), F.col("close").alias("current_price"),
        "short_trend", "long_trend")
