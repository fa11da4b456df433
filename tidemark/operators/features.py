"""Splits, scaling, targets and sequences for learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import (CODE, check_margins, is_sliced, keys_of, safe_ratio, series_window,
                                settle, with_position)
from ..params import KINDS, MODEL_FEATURES, SplitParams, TrendParams
from .indicators import DEFAULT


def rows_before(ratio: float, rows: Column | None = None) -> Column:
    """``int(rows * ratio)`` in double arithmetic."""
    rows = F.col("n") if rows is None else rows
    return F.floor(rows.cast("double") * F.lit(ratio))


def time_split(prices: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Chronological two-way split of each series."""
    df = with_position(prices)
    part = F.when(F.col("pos") < rows_before(ratio), "train").otherwise("test")
    return df.withColumn("split", part)


def time_split_3way(prices: DataFrame, s: SplitParams = SplitParams()) -> DataFrame:
    """Chronological split into train, val and test; a part that is too short is left out."""
    df = with_position(prices)
    head = rows_before(s.head_ratio) if s.test_ratio > 0 else F.col("n")
    train = rows_before(s.train_share_of_head, head) if s.validation_ratio > 0 else head
    df = df.withColumns({"head": head, "train": train})
    pos = F.col("pos")
    part = (F.when((pos < F.col("train")) & (F.col("train") >= s.min_train_rows), "train")
            .when((pos >= F.col("train")) & (pos < F.col("head"))
                  & (F.col("head") - F.col("train") >= s.min_other_rows), "val")
            .when((pos >= F.col("head")) & (F.col("n") - F.col("head") >= s.min_other_rows), "test"))
    return df.withColumn("split", part).where(F.col("split").isNotNull()).drop("head", "train")


def model_features(df: DataFrame) -> list[str]:
    found = [c for c in MODEL_FEATURES if c in df.columns]
    if not found:
        raise ValueError("none of the model's input columns are present")
    return found


def ffill_features(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Last known value, 0 where there was none yet."""
    cols = cols or model_features(df)
    so_far = series_window(df).rowsBetween(Window.unboundedPreceding, 0)
    known = {c: F.last(c, ignorenulls=True).over(so_far) for c in cols}
    if not is_sliced(df):
        return df.withColumns({c: F.coalesce(known[c], F.lit(0)) for c in cols})
    # A slab does not see what lies before its margin: bring the last known value along.
    last_of = lambda c, rows: F.max_by(c, F.when(F.col(c).isNotNull() & rows, F.col("pos")))
    ends = df.where("home").groupBy(CODE, "slab").agg(
        *[last_of(c, F.lit(True)).alias(c) for c in cols],
        *[last_of(c, ~F.col("late")).alias(f"_{c}") for c in cols])
    past = Window.partitionBy(CODE).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(CODE, (F.col("slab") + 1).alias("slab"), *[
        F.coalesce(f"_{c}", F.last(c, ignorenulls=True).over(past)).alias(f"_{c}") for c in cols])
    out = df.withColumns(known).join(carried, [CODE, "slab"], "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}", F.lit(0)) for c in cols}).drop(
        *[f"_{c}" for c in cols])


def numeric_columns(df: DataFrame) -> list[str]:
    apart = {CODE, "date", "pos", "n", "slab"}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in apart]


def fit_scaler(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean and population deviation per code and column, one wide row per code. A column
    that never changes is scaled by 1."""
    cols = cols or numeric_columns(df)
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return settle(df).groupBy(CODE).agg(
        *[F.struct(F.avg(c).alias("mean"), scale(c).alias("scale")).alias(c) for c in cols])


def scaler_params(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The scaler as a long table (stock_code, feature, mean, scale)."""
    cols = cols or numeric_columns(df)
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean"), F.col(f"{c}.scale"))
        for c in cols]))
    return fit_scaler(df, cols).select(CODE, each.alias("x")).select(CODE, "x.*")


def scale_features(df: DataFrame, scaler: DataFrame | None = None,
                   cols: list[str] | None = None) -> DataFrame:
    """Standardised columns; fits on the table itself unless a scaler is given."""
    cols = cols or numeric_columns(df)
    scaler = fit_scaler(df, cols) if scaler is None else scaler
    by = scaler.select(CODE, F.struct(*cols).alias("_by"))
    return df.join(by, CODE).withColumns({
        c: (F.col(c) - F.col(f"_by.{c}.mean")) / F.col(f"_by.{c}.scale") for c in cols
    }).drop("_by")


def training_targets(features: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    """The five labels: two trend classes, two forward returns, one confidence."""
    check_margins(features, 0, p.long_window)
    w = series_window(features)
    ahead = lambda k: F.coalesce(safe_ratio(F.lead("close", k).over(w), F.col("close")) - 1, F.lit(0.0))
    sure = (F.coalesce("short_trend_strength", F.lit(0.0))
            * F.coalesce("short_trend_consistency", F.lit(0.5)))
    return features.withColumns({
        **{f"{k}_trend_label": (F.coalesce(f"{k}_trend_direction", F.lit(0)) + 1).cast("double")
           for k in KINDS},
        **{f"{k}_reversal_label": ahead(p.window(k)) for k in KINDS},
        "confidence_label": F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0)),
    })


def long_enough(df: DataFrame, rows: int) -> DataFrame:
    return with_position(df).where(F.col("n") >= rows)


def feature_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def sequences(features: DataFrame, lookback: int, cols: list[str] | None = None) -> DataFrame:
    """For each row the features of the ``lookback`` rows before it, within its own series.
    Series shorter than ``lookback + 10`` rows are left out."""
    cols = cols or model_features(features)
    check_margins(features, lookback)
    df = long_enough(ffill_features(features, cols), lookback + 10)
    before = series_window(df).rowsBetween(-lookback, -1)
    df = df.withColumn("sequence", F.collect_list(feature_array(cols)).over(before))
    return df.where(F.size("sequence") == lookback)


def last_sequences(features: DataFrame, lookback: int, cols: list[str] | None = None) -> DataFrame:
    """The most recent sequence of each code (and member of an ensemble), its last row included."""
    cols = cols or model_features(features)
    df = settle(ffill_features(features, cols))
    df = with_position(df).where(F.col("pos") >= F.col("n") - lookback)
    rows = F.sort_array(F.collect_list(F.struct("pos", feature_array(cols).alias("x"))))
    keys = keys_of(df)
    return (df.groupBy(*keys).agg(F.max("n").alias("n"), rows.alias("rows"))
            .where(F.col("n") >= lookback)
            .select(*keys, F.transform("rows", lambda r: r["x"]).alias("sequence")))
