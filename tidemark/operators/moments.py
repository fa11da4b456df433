"""Means and deviations that new rows are added to without reading the old ones.

A batch of rows leaves, for each code and feature, how many values it had, their mean and the sum of
their squared deviations from it. Those three of any number of batches make the ones of all rows, so a
scaler is renewed from the new rows and from tables as small as codes times features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import CODE, settle
from .features import numeric_columns

SCHEMA = "stock_code string, feature string, n long, mean double, squares double"


def moments(rows: DataFrame, cols: list[str] | None = None, *by: str) -> DataFrame:
    """stock_code, feature, n, mean and squares of the values that are not NULL, apart for each `by`."""
    cols = cols or [c for c in numeric_columns(rows) if c not in by]
    each = settle(rows).groupBy(CODE, *by).agg(*[
        F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                 (F.var_pop(c) * F.count(c)).alias("squares")).alias(f"_{c}") for c in cols])
    told = each.select(CODE, *by, F.explode(F.array(*[f"_{c}" for c in cols])).alias("m"))
    return told.select(CODE, *by, "m.*").where("n > 0")


def merged(parts: DataFrame) -> DataFrame:
    """The moments of all parts together. The mean of all comes first: deviations from it are small
    numbers, where a difference of large sums of squares would lose them."""
    all_parts = Window.partitionBy(CODE, "feature")
    whole = F.sum(F.col("n") * F.col("mean")).over(all_parts) / F.sum("n").over(all_parts)
    off = (F.col("mean") - F.col("whole")) * (F.col("mean") - F.col("whole"))
    return parts.withColumn("whole", whole).groupBy(CODE, "feature").agg(
        F.sum("n").alias("n"), F.first("whole").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * off).alias("squares"))


def scaler_of(parts: DataFrame) -> DataFrame:
    """stock_code, feature, mean and scale, as ``scaler_params`` says of all rows at once."""
    deviation = F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / F.col("n"))
    return merged(parts).select(CODE, "feature", "mean", F.when(deviation > 0, deviation).otherwise(1.0).alias("scale"))


def wide_scaler(scaler: DataFrame, cols: list[str]) -> DataFrame:
    """A row a code with mean and scale of each column, as ``scale_features`` takes it."""
    mine = lambda c: F.max(F.when(F.col("feature") == c, F.struct("mean", "scale"))).alias(c)
    return scaler.groupBy(CODE).agg(*[mine(c) for c in cols])


def add_batch(rows: DataFrame, store: str, batch: int, cols: list[str] | None = None) -> None:
    """Keeps the moments of new rows under the batch's number; a batch that is repeated replaces itself."""
    moments(rows, cols).write.mode("overwrite").parquet(f"{store}/batch={batch}")


def stored_moments(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SCHEMA + ", batch int").parquet(store)
