"""Sinks of predictions and features, and tables that cut a long lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import CODE
from ..session import workspace

# The columns of the predictions file, in their order.
PREDICTION_COLUMNS = (
    "stock_code", "error", "timestamp", "short_trend", "long_trend",
    "short_reversal_price", "long_reversal_price", "short_confidence", "long_confidence",
    "current_price", "analysis_date",
)


def prediction_rows(predictions: DataFrame, run_ts: str) -> DataFrame:
    """The eleven columns of the predictions file; a failed code has no figures."""
    df = predictions if "error" in predictions.columns else predictions.withColumn(
        "error", F.lit(None).cast("string"))
    df = df.withColumns({
        "timestamp": F.lit(run_ts),
        "analysis_date": F.date_format("analysis_date", "yyyy-MM-dd"),
    })
    ok = F.col("error").isNull()
    kept = {CODE, "error", "timestamp"}
    return df.select(*[F.col(c) if c in kept else F.when(ok, F.col(c)).alias(c)
                       for c in PREDICTION_COLUMNS])


def csv_path(path: str) -> str:
    """The output path with a ``.csv`` ending in place of a ``.json`` one."""
    stem = path.removesuffix(".json")
    return stem if stem.endswith(".csv") else f"{stem}.csv"


def write_predictions_csv(predictions: DataFrame, path: str, run_ts: str) -> str:
    path = csv_path(path)
    prediction_rows(predictions, run_ts).orderBy(CODE).write.option("header", True).csv(path)
    return path


def write_predictions_json(predictions: DataFrame, path: str, run_ts: str) -> str:
    """One object per code, nested parts included."""
    predictions.withColumn("timestamp", F.lit(run_ts)).write.json(path)
    return path


def save_features(features: DataFrame, path: str) -> None:
    features.write.parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_by_code(df: DataFrame, purpose: str, parts: int | None = None, *also: str) -> DataFrame:
    """``stored``, in buckets by code (and ``also`` other columns): windows, sums and joins by those do
    not shuffle it again. There are as many buckets as a shuffle has partitions, or as many as told: rows
    that lie in so many parts by the same columns already leave a file a bucket."""
    spark, path = df.sparkSession, workspace(df.sparkSession, purpose)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, CODE, *also).option("path", path).saveAsTable(name)
    return spark.table(name)


def stored(df: DataFrame, purpose: str = "table") -> DataFrame:
    """The same rows read back from a table in the shared folder. What follows no longer
    depends on the tasks that made them."""
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
