"""Renewing predictions as new price rows arrive.

A refresh is started by the user (``availableNow``) or runs on. Each micro-batch is added
to the stored prices under its own number and the codes it touches are predicted anew; a
batch that is replayed after a failure overwrites what it wrote before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.series import CODE
from ..operators.cleaning import clean_prices
from ..operators.forecasts import predict_stock
from ..operators.selection import distinct_codes, semi_join_codes
from ..params import TrendParams

PRICES = "stock_code string, date date, open double, high double, low double, close double, volume double"


# Folders that the codes of the store are dealt to by a hash.
BUCKETS = 64


def bucket_of(code: str = CODE) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(BUCKETS)).cast("int")


def current_prices(spark: SparkSession, store: str, upto: int,
                   buckets: list[int] | None = None) -> DataFrame:
    """Stored prices of all batches so far, a day that came again in its latest version. Only
    the folders of the given buckets are read."""
    rows = spark.read.schema(PRICES + ", batch long, bucket int").parquet(store).where(F.col("batch") <= upto)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    values = F.struct("open", "high", "low", "close", "volume")
    return (rows.groupBy(CODE, "date").agg(F.max_by(values, F.struct("batch", values)).alias("x"))
            .select(CODE, "date", "x.*"))


def refresh_predictions(raw: DataFrame, store: str, out: str, checkpoint: str,
                        p: TrendParams = TrendParams(), once: bool = True,
                        ensembles: bool = True) -> StreamingQuery:
    """Starts a refresh from a stream of raw price rows that carry their ``stock_code``; without
    ``ensembles`` the predictions have no votes."""
    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in PRICES.split(", ")]
        (clean_prices(batch).select(*columns).withColumn("bucket", bucket_of())
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}"))
        new = spark.read.schema(PRICES + ", bucket int").parquet(f"{store}/batch={number}")
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        prices = semi_join_codes(current_prices(spark, store, number, buckets), distinct_codes(new))
        predict_stock(prices, p, ensembles=ensembles).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact(spark: SparkSession, store: str, into: str, upto: int) -> None:
    """The store's batches up to this one as a single batch of a new store, which later batches
    are added to; the old store is left as it is."""
    rows = current_prices(spark, store, upto).withColumn("bucket", bucket_of())
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{into}/batch={upto}")


def latest_predictions(spark: SparkSession, out: str) -> DataFrame:
    """The newest prediction of every code."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in (CODE, "batch")]
    return (df.groupBy(CODE).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
            .select(CODE, "x.*"))
