"""Trend calls, expected reversal prices and confidence per code.

Everything a forecast needs is gathered by one pass: trailing windows over the series, a
rank counted from its end, and conditional aggregates per code (:func:`profile`). The
aggregates are combined before any shuffle and columns nobody asks for are pruned."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import (CODE, full_window, is_sliced, keys_of, position_columns, recency,
                                series_window, settle, tail)
from ..params import KINDS, TrendParams
from ..sources.tables import stored_by_code
from .indicators import DEFAULT, change, ma_columns
from .reversals import reversal_stats, reversals
from .trends import symbol_of_slope, trend_as_of

RECENT = 20


def profile(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    """One row per code (and member of an ensemble) with the figures forecasts are made of."""
    keys = keys_of(prices)
    w = series_window(prices)
    df = prices.withColumns({
        **position_columns(prices), **ma_columns(prices, p),
        "r": change("close", w),
        "move": F.col("close") - F.lag("close").over(w),
        "pv": full_window(F.stddev_samp, F.col("close"), w, p.volatility_window),
    })
    df = df.withColumns({f"{k}_seen": trend_as_of(df, k, p) for k in KINDS})
    df = df.withColumns({f"{k}_turned": F.col(f"{k}_seen") != F.lag(f"{k}_seen").over(w)
                         for k in KINDS})
    df = settle(recency(df))
    rd, n = F.col("rd"), F.col("n")
    upto = lambda rows, x: F.when(rd <= rows, F.col(x))
    aggs = {
        "data_points": F.max("n"),
        "current_price": F.max(F.when(rd == 1, F.col("close"))),
        "analysis_date": F.max("date"),
        "recent_spread": F.stddev_samp(upto(RECENT, "r")),
        "whole_spread": F.stddev_samp("r"),
        "recent_pv": F.avg(upto(RECENT, "pv")),
        "usual_pv": F.avg("pv"),
    }
    for k in KINDS:
        rows = p.window(k)
        looked = F.when(n >= rows, F.lit(rows)).otherwise(F.least(F.lit(10), n))
        for i in (1, 2, 3):
            aggs[f"{k}_ma_{i}"] = F.max(F.when(rd == i, F.col(f"ma_{rows}")))
        aggs[f"{k}_seen"] = F.max(F.when(rd == 1, F.col(f"{k}_seen")))
        aggs[f"{k}_turns"] = F.count_if((rd <= rows - 1) & F.col(f"{k}_turned"))
        aggs[f"{k}_spread"] = F.stddev_samp(upto(2 * rows, "r"))
        aggs[f"{k}_steps"] = F.count_if((rd <= looked - 1) & F.col("move").isNotNull())
        aggs[f"{k}_ups"] = F.count_if((rd <= looked - 1) & (F.col("move") > 0))
        aggs[f"{k}_downs"] = F.count_if((rd <= looked - 1) & (F.col("move") < 0))
    return df.groupBy(*keys).agg(*[a.alias(name) for name, a in aggs.items()])


def mean_of_known(factors: list[Column]) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(0.0)) for f in factors])
    known = reduce(lambda a, b: a + b, [F.when(f.isNotNull(), 1).otherwise(0) for f in factors])
    return F.when(known > 0, total / F.when(known > 0, known))


def basic_trend(kind: str, p: TrendParams) -> dict[str, Column]:
    """Trend from the last three averages without a model: the rise is divided by their
    number, and the confidence is at most 0.7."""
    newest, middle, oldest = (F.col(f"{kind}_ma_{i}") for i in (1, 2, 3))
    held = F.when(oldest.isNotNull(), 3).when(middle.isNotNull(), 2)
    slope = (newest - F.coalesce(oldest, middle)) / held
    short = F.col("data_points") < p.window(kind)
    weak = F.least(F.abs(slope) / F.lit(p.trend_threshold), F.lit(1.0)) * 0.7
    if p.trend_threshold == 0:
        weak = F.lit(0.7)
    return {
        "trend": F.when(slope.isNull() | short, "0").otherwise(
            symbol_of_slope(slope, p.trend_threshold)),
        "trend_confidence": F.when(slope.isNull() | short, 0.3).otherwise(weak),
        "trend_method": F.when(short, "insufficient_data")
        .when(slope.isNull(), "insufficient_ma").otherwise("fallback_analysis"),
    }


def basic_reversal(kind: str, p: TrendParams) -> dict[str, Column]:
    """A price one recent standard deviation of returns away from the last close, on the
    side the trend points to (up when it points nowhere)."""
    price, spread = F.col("current_price"), F.col(f"{kind}_spread")
    short = F.col("data_points") - 1 < p.window(kind)
    side = F.when(basic_trend(kind, p)["trend"] == "-", -1.0).otherwise(1.0)
    return {
        "reversal_price": F.when(short, price).otherwise(price * (1 + spread * side)),
        "reversal_low": F.when(short, price).otherwise(price * (1 - spread)),
        "reversal_high": F.when(short, price).otherwise(price * (1 + spread)),
        "reversal_confidence": F.when(short, 0.3).otherwise(0.5),
        "reversal_method": F.when(short, "insufficient_data").otherwise("fallback_analysis"),
    }


def for_kinds(make, p: TrendParams) -> list[Column]:
    return [c.alias(f"{k}_{name}") for k in KINDS for name, c in make(k, p).items()]


def end_rows(p: TrendParams) -> int:
    """The last rows, all that the forecasts without a model look at."""
    return 2 * p.long_window + 1


def end_profile(prices: DataFrame, p: TrendParams) -> DataFrame:
    """The profile of the last rows."""
    return profile(tail(prices, end_rows(p)), p)


def fallback_trend(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return end_profile(prices, p).select(CODE, *for_kinds(basic_trend, p))


def fallback_reversal(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return end_profile(prices, p).select(CODE, "current_price",
                                     *for_kinds(basic_reversal, p))


def confidence_of(kind: str, p: TrendParams, base: Column | float = 0.5) -> Column:
    """Confidence in percent: a base rating times the mean of data completeness, calm of
    the last 20 returns against all, and how one-sided the last moves were."""
    n = F.col("data_points")
    complete = (F.when(n >= p.long_window + 10, 1.0)
                .when(n >= p.short_window, 0.7).otherwise(0.3))
    ratio = F.col("recent_spread") / F.when(F.col("whole_spread") > 0, F.col("whole_spread"))
    calm = F.when(n >= RECENT, F.when(ratio.isNull(), 0.7).otherwise(
        F.greatest(F.lit(0.3), 1 - (ratio - 1) * 0.5)))
    steps = F.col(f"{kind}_steps")
    one_sided = F.when(steps > 0, F.greatest(f"{kind}_ups", f"{kind}_downs")
                       / F.when(steps > 0, steps))
    rating = base if isinstance(base, Column) else F.lit(base)
    percent = rating * mean_of_known([complete, calm, one_sided]) * 100
    return F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0))


def confidence(prices: DataFrame, kind: str, p: TrendParams = DEFAULT,
               base: Column | float = 0.5) -> DataFrame:
    return profile(prices, p).select(CODE, confidence_of(kind, p, base).alias("confidence"))


def clamp_reversal_price(price: Column, change: Column) -> Column:
    """The price after a predicted change, kept within half and twice the current one."""
    return F.least(F.greatest(price * (1 + change), price * 0.5), price * 2.0)


def adjust_reversal_confidence(base: Column, change: Column, spread: Column) -> Column:
    """Lowers a rating for extreme or negligible changes and for volatile series."""
    size = F.abs(change)
    by_size = F.when(size > 0.5, 0.7).when(size < 0.01, 0.8).otherwise(1.0)
    by_spread = F.when(spread > 0.05, 0.9).when(spread < 0.01, 1.1).otherwise(1.0)
    return F.least(F.greatest(base * by_size * by_spread, F.lit(0.0)), F.lit(1.0))


def regularity_factors(kind: str, p: TrendParams) -> list[Column]:
    """How regular the reversals came, how steady the trend was, how calm prices are."""
    regular = F.greatest(F.lit(0.0),
                         1 - F.col("gap_std") / F.greatest(F.col("gap_mean"), F.lit(1.0)))
    rows = p.window(kind)
    steady = F.when(F.col("data_points") >= rows,
                    F.greatest(F.lit(0.0), 1 - F.col(f"{kind}_turns") / F.lit(float(rows))))
    usual = F.when(F.col("usual_pv") > 0, F.col("usual_pv"))
    calm = F.greatest(F.lit(0.0), 1 - F.col("recent_pv") / usual)
    return [regular, steady, F.when(usual.isNotNull(), calm)]


def regularity(kind: str, p: TrendParams) -> Column:
    known = F.coalesce(mean_of_known(regularity_factors(kind, p)), F.lit(0.5))
    return F.when(F.coalesce("reversal_count", F.lit(0)) < 3, 0.3).otherwise(known)


def with_code(prices: DataFrame) -> DataFrame:
    """Said of both sides of a join by code, it lets them share one scan and one shuffle:
    the optimizer would add the condition to the optional side alone."""
    return prices.where(F.col(CODE).isNotNull())


def with_reversal_stats(prices: DataFrame, kind: str, p: TrendParams) -> DataFrame:
    prices = with_code(prices)
    stats = reversal_stats(reversals(prices, kind, p)).drop("trend_type")
    return profile(prices, p).join(stats, CODE, "left")


def reversal_confidence(prices: DataFrame, kind: str, p: TrendParams = DEFAULT) -> DataFrame:
    return with_reversal_stats(prices, kind, p).select(
        CODE, F.coalesce("reversal_count", F.lit(0)).alias("reversal_count"),
        regularity(kind, p).alias("confidence"))


def next_reversal_of(kind: str, p: TrendParams) -> Column:
    few = F.coalesce("reversal_count", F.lit(0)) < 2
    seen, price = F.col(f"{kind}_seen"), F.col("current_price")
    half = F.col("avg_magnitude") * 0.5
    return F.struct(
        F.when(few, price).when(seen == "+", price + half).when(seen == "-", price - half)
        .otherwise(F.col("last_price")).alias("price"),
        F.when(few, 0.0).otherwise(regularity(kind, p)).alias("confidence"),
        F.when(few, "unknown").when(seen == "+", "peak").when(seen == "-", "trough")
        .otherwise("sideways").alias("type"),
        F.when(~few, seen).alias("current_trend"),
        F.when(~few, F.col("avg_magnitude")).alias("avg_magnitude"))


def next_reversal(prices: DataFrame, kind: str, p: TrendParams = DEFAULT) -> DataFrame:
    """Expected price of the next reversal from the size of the last ones."""
    return with_reversal_stats(prices, kind, p).select(
        CODE, next_reversal_of(kind, p).alias("next")).select(CODE, "next.*")


def kept_slabs(prices: DataFrame) -> DataFrame:
    """What the profile and the reversals look at of a series in slabs, stored in buckets by slab: they
    look at it a dozen times, and would lay it out each time. A daily series passes unchanged."""
    if not is_sliced(prices):
        return prices
    told = prices.schema["slab"].metadata
    made = prices.select(CODE, "slab", "home", "late", "date", "close", "pos", "n")
    return stored_by_code(made, "slabs", told.get("parts"), "slab").withMetadata("slab", told)


def with_both_next(prices: DataFrame, p: TrendParams) -> DataFrame:
    """The profile with both expected reversals and the latest reversals beside it."""
    prices, keys = kept_slabs(with_code(prices)), keys_of(prices)
    df = profile(prices, p)
    for kind in KINDS:
        stats = reversal_stats(reversals(prices, kind, p)).drop("trend_type")
        df = df.join(stats, keys, "left").withColumns({
            f"{kind}_next": next_reversal_of(kind, p),
            f"{kind}_rated": F.struct(
                F.coalesce("reversal_count", F.lit(0)).alias("reversal_count"),
                regularity(kind, p).alias("confidence")),
            f"{kind}_recent": F.coalesce("recent", F.slice("recent", 1, 0)),
        }).drop(*[c for c in stats.columns if c not in keys])
    return df


def stacked(df: DataFrame, part: str) -> DataFrame:
    """A row for each kind, from one profile."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("trend_type"), F.col(f"{k}_{part}").alias("x"))
                               for k in KINDS]))
    return df.select(CODE, each.alias("k")).select(CODE, "k.trend_type", "k.x.*")


def next_reversals(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return stacked(with_both_next(prices, p), "next")


def reversal_confidences(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return stacked(with_both_next(prices, p), "rated")


def trend_summary(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return with_both_next(prices, p).select(
        CODE, "current_price", "analysis_date",
        F.col("short_seen").alias("short_trend"), F.col("long_seen").alias("long_trend"),
        (F.col("short_seen") == F.col("long_seen")).alias("trend_agreement"),
        F.col("short_next").alias("short_reversal_prediction"),
        F.col("long_next").alias("long_reversal_prediction"),
        F.struct(F.col("short_recent").alias("short"),
                 F.col("long_recent").alias("long")).alias("recent_reversals"))


# The confidence of a trend that was fitted, not modelled; and what the methods are called.
FITTED_CONFIDENCE = 0.6
METHODS = ("basic", "analyzer")
ANSWER = ("trend", "trend_confidence", "trend_method", "reversal_price", "reversal_confidence",
          "reversal_method")

Answer = Callable[[DataFrame, TrendParams], DataFrame]


def answer_columns(parts: dict[str, dict[str, Column]], p: TrendParams,
                   base: Column | float = 0.5) -> list[Column]:
    """The columns that every method answers with, from a table with the codes' profile."""
    return [CODE, "data_points", "current_price", "analysis_date",
            *[parts[k][name].alias(f"{k}_{name}") for k in KINDS for name in ANSWER],
            *[confidence_of(k, p, base).alias(f"{k}_confidence") for k in KINDS]]


def basic_answers(prices: DataFrame, p: TrendParams) -> DataFrame:
    parts = {k: {**basic_trend(k, p), **basic_reversal(k, p)} for k in KINDS}
    keys = keys_of(prices)
    return profile(prices, p).select(*keys[1:], *answer_columns(parts, p))


def analyzer_answers(prices: DataFrame, p: TrendParams) -> DataFrame:
    """The fitted trend, and the price that the series' own reversals let expect."""
    parts = {k: {
        "trend": F.col(f"{k}_seen"), "trend_confidence": F.lit(FITTED_CONFIDENCE),
        "trend_method": F.lit("fallback_analysis"),
        "reversal_price": F.col(f"{k}_next.price"),
        "reversal_confidence": F.col(f"{k}_next.confidence"),
        "reversal_method": F.lit("fallback_analysis"),
    } for k in KINDS}
    return with_both_next(prices, p).select(*keys_of(prices)[1:], *answer_columns(parts, p))


def answer_of(method: str | Answer) -> Answer:
    """The answers of a method by name, or those of models (see ``learning.model_answers``)."""
    if callable(method):
        return method
    if method not in METHODS:
        raise ValueError("method must be 'basic' or 'analyzer'")
    return basic_answers if method == "basic" else analyzer_answers


def predict_stock(prices: DataFrame, p: TrendParams = DEFAULT, method: str | Answer = "basic",
                  ensembles: bool = True) -> DataFrame:
    """The complete prediction of every code, one row each.

    ``basic`` calls the trend from the last averages and the reversal from recent
    volatility; ``analyzer`` uses the fitted trend and the series' own reversals; models
    answer where they were given. Ensembles repeat the same method on disturbed prices."""
    n = F.col("data_points")
    out = answer_of(method)(prices, p).select(
        CODE, "current_price", "analysis_date",
        *[f"{k}_{part}" for part in ("trend", "reversal_price", "confidence") for k in KINDS],
        F.struct(*[f"{k}_{m}_method" for m in ("trend", "reversal") for k in KINDS])
        .alias("prediction_methods"),
        F.struct(n.alias("data_points"),
                 (n >= p.short_window).alias("sufficient_short"),
                 (n >= p.long_window).alias("sufficient_long"),
                 (n >= p.lookback).alias("sufficient_ml")).alias("data_quality"))
    if ensembles and p.ensemble_size > 1:
        from .ensembles import ensemble_structs
        out = out.join(ensemble_structs(prices, p, method), CODE, "left")
    return out


def batch_predict(prices: DataFrame, codes: DataFrame, p: TrendParams = DEFAULT,
                  method: str | Answer = "basic", ensembles: bool = True) -> DataFrame:
    """A row for every requested code; ``error`` tells why one has no prediction."""
    asked = codes.select(CODE).distinct()
    made = predict_stock(prices.join(asked, CODE, "left_semi"), p, method, ensembles)
    n = F.coalesce("data_quality.data_points", F.lit(0))
    error = F.when(n == 0, "no price data").when(n < p.min_data_points, "insufficient data")
    df = asked.join(made, CODE, "left").withColumn("error", error)
    blank = [c for c in made.columns if c != CODE]
    return df.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in blank})


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Counts, trend distribution, confidence statistics and mean expected change."""
    ok = F.col("error").isNull()
    aggs = [F.count(F.lit(1)).alias("total_stocks"),
            F.count_if(ok).alias("successful_predictions"),
            F.count_if(~ok).alias("failed_predictions"),
            (F.count_if(ok) / F.count(F.lit(1))).alias("success_rate")]
    for k in KINDS:
        for name, s in (("up", "+"), ("down", "-"), ("sideways", "0")):
            aggs.append(F.count_if(ok & (F.col(f"{k}_trend") == s)).alias(f"{k}_{name}"))
        c = F.when(ok, F.col(f"{k}_confidence"))
        aggs += [F.avg(c).alias(f"{k}_confidence_mean"),
                 F.stddev_pop(c).alias(f"{k}_confidence_std"),
                 F.min(c).alias(f"{k}_confidence_min"),
                 F.max(c).alias(f"{k}_confidence_max")]
        price = F.when(ok & (F.col("current_price") > 0), F.col("current_price"))
        aggs.append(F.avg((F.col(f"{k}_reversal_price") - price) / price)
                    .alias(f"{k}_avg_change"))
    return predictions.agg(*aggs)


def trend_distribution(predictions: DataFrame) -> DataFrame:
    """Number of codes per horizon and trend."""
    ok = predictions.where(F.col("error").isNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"),
                                         F.col(f"{k}_trend").alias("trend")) for k in KINDS]))
    return ok.select(pairs.alias("x")).groupBy("x.horizon", "x.trend").agg(
        F.count(F.lit(1)).alias("codes"))
