"""Predictions repeated on slightly disturbed prices, and their vote.

Each member is predicted by the method that predicts the series itself. The disturbance is
a normal number derived from a hash of code, date, member and column; it is the same in
every run and after a lost task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import CODE, is_sliced, tail, with_position
from ..params import KINDS, TrendParams
from .forecasts import ANSWER, Answer, answer_of
from .indicators import DEFAULT

NOISE = 0.001
MIN_ROWS = 10


def digest_of(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def normal_of(digest: Column) -> Column:
    number = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
    first = (number(1) + 1) / F.lit(2.0 ** 32 + 1)
    second = number(9) / F.lit(2.0 ** 32)
    return F.sqrt(-2 * F.log(first)) * F.cos(F.lit(2 * math.pi) * second)


def members(prices: DataFrame, p: TrendParams = DEFAULT, method: str | Answer = "basic") -> DataFrame:
    """The disturbed copies of every series, told apart by ``member``.

    Without a model the ``basic`` method looks at the last rows only, and only those are
    copied, after the shuffle; any other method sees whole series. Of a method that says how many
    last ``rows`` it looks at, only the closes of rows before those are disturbed."""
    df = tail(prices, 2 * p.long_window + 1) if method == "basic" else with_position(prices)
    # what the members of a row share is made before they are, and a digest is made once: inside a
    # condition each mention of it would be computed; without code and date there is nothing to share
    row = F.concat_ws("|", CODE, F.date_format("date", "yyyy-MM-dd"))
    df = df.withColumn("_row", F.when(F.col(CODE).isNotNull() | F.col("date").isNotNull(), row))
    df = df.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(p.ensemble_size - 1))))
    rows = getattr(method, "rows", None)
    seen = lambda c: F.lit(True) if rows is None or c == "close" else F.col("n") - F.col("pos") <= rows
    told = [c for c in ("open", "high", "low", "close") if c in df.columns]
    noisy = lambda c: seen(c) & (F.col("n") > MIN_ROWS)
    df = df.withColumns({f"_{c}": F.when(noisy(c), digest_of(F.col("_row"), F.col("member").cast("string"), F.lit(c)))
                         for c in told})
    factor = lambda c: F.when(noisy(c), 1 + NOISE * normal_of(F.col(f"_{c}"))).otherwise(1.0)
    return df.withColumns({c: F.col(c) * factor(c) for c in told}).drop("_row", *[f"_{c}" for c in told])


def member_predictions(prices: DataFrame, p: TrendParams = DEFAULT,
                       method: str | Answer = "basic") -> DataFrame:
    """The answers on each copy. A method that knows nothing of members is given copies that are
    series of their own, ``<code>#<member>``; to one that does, they stay with their series and
    need no shuffle. The analyzer knows members of daily series."""
    cols = [f"{k}_{name}" for k in KINDS for name in ANSWER]
    answer = answer_of(method)
    beside = lambda df: answer(members(df, p, method), p).select(CODE, "member", *cols)

    def apart(df: DataFrame) -> DataFrame:
        copies = members(df, p, method).withColumn(CODE, F.concat_ws("#", CODE, "member")).drop("member")
        return answer(copies, p).select(
            F.regexp_extract(CODE, "^(.*)#([0-9]+)$", 1).alias(CODE),
            F.regexp_extract(CODE, "#([0-9]+)$", 1).cast("int").alias("member"), *cols)

    if method == "basic" or hasattr(method, "rows"):
        return beside(prices)
    if method == "analyzer" and not is_sliced(prices):
        # rows without a code make a series of their own, answered under the empty code
        return beside(prices).unionByName(apart(prices.where(F.col(CODE).isNull())))
    return apart(prices)


def vote(c: str) -> Column:
    """The most frequent of the three trends; of equally frequent ones up, then down."""
    up, down, flat = (F.count_if(F.col(c) == s) for s in ("+", "-", "0"))
    return (F.when((up >= down) & (up >= flat), "+")
            .when(down >= flat, "-").otherwise("0"))


def trend_votes() -> list[Column]:
    both = (F.col("short_trend_confidence") + F.col("long_trend_confidence")) / 2
    return ([vote(f"{k}_trend").alias(f"{k}_trend") for k in KINDS]
            + [F.avg(f"{k}_trend_confidence").alias(f"{k}_confidence") for k in KINDS]
            + [F.avg(both).alias("ensemble_confidence")])


def reversal_votes() -> list[Column]:
    both = (F.col("short_reversal_confidence") + F.col("long_reversal_confidence")) / 2
    return ([F.avg(f"{k}_reversal_price").alias(f"{k}_reversal_price") for k in KINDS]
            + [F.avg(f"{k}_reversal_confidence").alias(f"{k}_confidence") for k in KINDS]
            + [F.avg(both).alias("ensemble_confidence")]
            + [F.stddev_pop(f"{k}_reversal_price").alias(f"{k}_price_std") for k in KINDS])


def ensemble_trend(prices: DataFrame, p: TrendParams = DEFAULT,
                   method: str | Answer = "basic") -> DataFrame:
    return member_predictions(prices, p, method).groupBy(CODE).agg(*trend_votes())


def ensemble_reversal(prices: DataFrame, p: TrendParams = DEFAULT,
                      method: str | Answer = "basic") -> DataFrame:
    return member_predictions(prices, p, method).groupBy(CODE).agg(*reversal_votes())


def ensemble_structs(prices: DataFrame, p: TrendParams = DEFAULT,
                     method: str | Answer = "basic") -> DataFrame:
    """Both votes as two structs, from one pass over the members."""
    trend, reversal = trend_votes(), reversal_votes()
    named = member_predictions(prices, p, method).groupBy(CODE)
    return named.agg(F.struct(*trend).alias("ensemble_trends"),
                     F.struct(*reversal).alias("ensemble_reversals"))
