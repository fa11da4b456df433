"""Which rows and which codes take part."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import CODE, settle
from .medians import median_by_selection


def date_filter(prices: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range of days; a plain comparison, so it reaches a parquet scan. Times of
    the last day belong to it."""
    if start:
        prices = prices.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        prices = prices.where(F.col("date") < F.date_add(F.lit(end).cast("date"), 1))
    return prices


def points_per_stock(prices: DataFrame) -> DataFrame:
    return settle(prices).groupBy(CODE).agg(F.count(F.lit(1)).alias("data_points"))


def min_history(prices: DataFrame, rows: int) -> DataFrame:
    """Codes with at least this many rows. The counts are combined before the shuffle and
    come back as a semi join, so a long series is never gathered to be counted."""
    kept = points_per_stock(prices).where(F.col("data_points") >= rows).select(CODE)
    return prices.join(kept, CODE, "left_semi")


def median_above(prices: DataFrame, threshold: float) -> DataFrame:
    """Codes whose exact median volume exceeds the threshold, in one pass with a state of
    four numbers per code: more than half of the volumes lie above it, or exactly half do
    and the two middle ones average above it."""
    v = F.col("volume")
    stats = settle(prices).groupBy(CODE).agg(
        F.count(v).alias("known"),
        F.count_if(v > threshold).alias("above"),
        F.max(F.when(v <= threshold, v)).alias("below_it"),
        F.min(F.when(v > threshold, v)).alias("above_it"),
    )
    most = F.col("above") * 2 > F.col("known")
    half = ((F.col("above") > 0) & (F.col("above") * 2 == F.col("known"))
            & ((F.col("below_it") + F.col("above_it")) / 2 > threshold))
    return stats.where(most | half).select(CODE)


def liquidity_filter(prices: DataFrame, threshold: float = 50_000) -> DataFrame:
    """Rows of codes that trade enough. A table without volumes passes unchanged."""
    if "volume" not in prices.columns:
        return prices
    return prices.join(median_above(prices, threshold), CODE, "left_semi")


def median_volume(prices: DataFrame) -> DataFrame:
    """Exact median volume per code from counts of equal volumes.

    Equal volumes are counted before the shuffle. A daily code has no more distinct volumes
    than the calendar has days, and a window ranks them; a series in slabs may be of any
    length, and its median is found by selection."""
    if "slab" in prices.columns:
        return median_by_selection(settle(prices), CODE, "volume", "median_volume")
    counts = (settle(prices).where(F.col("volume").isNotNull())
              .groupBy(CODE, "volume").agg(F.count(F.lit(1)).alias("rows")))
    up = Window.partitionBy(CODE).orderBy("volume").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({
        "upto": F.sum("rows").over(up),
        "known": F.sum("rows").over(Window.partitionBy(CODE)),
    })
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank)
    low = F.floor((F.col("known") + 1) / 2)
    high = F.floor(F.col("known") / 2) + 1
    return ranked.groupBy(CODE).agg(
        ((F.max(F.when(holds(low), F.col("volume")))
          + F.max(F.when(holds(high), F.col("volume")))) / 2).alias("median_volume"))


def distinct_codes(prices: DataFrame) -> DataFrame:
    return prices.select(CODE).distinct()


def semi_join_codes(prices: DataFrame, codes: DataFrame) -> DataFrame:
    """Prices of listed codes. The code list grows with the market, so it is left to the
    optimizer's measured size whether it is broadcast; a skewed code is split by the
    runtime's skew join otherwise."""
    return prices.join(codes.select(CODE).distinct(), CODE, "left_semi")


def anti_join_codes(table: DataFrame, codes: DataFrame) -> DataFrame:
    return table.join(codes.select(CODE).distinct(), CODE, "left_anti")


def latest_data(prices: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """The current full series of the given codes (a short list held by the caller)."""
    return prices if codes is None else prices.where(F.col(CODE).isin(list(codes)))


def latest_row(prices: DataFrame) -> DataFrame:
    """The last row of each series, by an aggregate that is combined before the shuffle."""
    prices = settle(prices)
    rest = [c for c in prices.columns if c != CODE]
    by = [c for c in ("date", "open", "high", "low", "close", "volume") if c in rest]
    row = F.max_by(F.struct(*rest), F.struct(*by)).alias("row")
    return prices.groupBy(CODE).agg(row).select(CODE, "row.*")


def head_codes(prices: DataFrame, rows: int) -> DataFrame:
    return distinct_codes(prices).orderBy(CODE).limit(rows)


def union_sources(*tables: DataFrame) -> DataFrame:
    """One long table of several; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def data_summary(prices: DataFrame) -> DataFrame:
    per_code = settle(prices).groupBy(CODE).agg(
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.count(F.lit(1)).alias("rows"))
    return per_code.agg(
        F.count(F.lit(1)).alias("total_stocks"),
        F.min("first").alias("earliest_start"),
        F.max("last").alias("latest_end"),
        F.sum("rows").alias("total_data_points"),
        F.avg("rows").alias("average_data_points"),
    )
