"""Bars from a stream of ticks.

Ticks of a code and a span of time are summed in the state of the stream: one row for each open bar,
whatever the number of its ticks, and combined before they are shuffled. A watermark says how late a
tick may come; a bar that it has passed is closed, its state is dropped, and ticks that
come later still are left out. Each micro-batch writes the bars it changed under its own number, so
that a batch replayed after a failure overwrites what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.series import CODE

VALUES = ("open", "high", "low", "close", "volume", "ticks")


def ticks_to_bars(ticks: DataFrame, width: str = "1 day") -> DataFrame:
    """stock_code, start, open, high, low, close, volume and ticks of ticks(stock_code, ts, seq, price,
    size), a stream or a table. Of ticks at one time the one with the smaller ``seq`` is earlier; a tick
    without a code, a time or a price is left out, and one without a size has none. ``ts`` is a
    timestamp with a time zone, as a watermark needs it."""
    known = ticks.where(F.col(CODE).isNotNull() & F.col("ts").isNotNull() & F.col("price").isNotNull())
    at = F.struct("ts", "seq")
    made = known.groupBy(CODE, F.window("ts", width).alias("span")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum(F.coalesce("size", F.lit(0.0))).alias("volume"),
        F.count(F.lit(1)).alias("ticks"))
    return made.select(CODE, F.col("span.start").alias("start"), *VALUES)


def write_bars(ticks: DataFrame, out: str, checkpoint: str, width: str = "1 day",
               lateness: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Starts building the bars of a stream of ticks; with ``once`` it ends with what is there now, and
    goes on from its checkpoint the next time."""
    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    made = ticks_to_bars(ticks.withWatermark("ts", lateness), width)
    writer = made.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_bars(spark: SparkSession, out: str) -> DataFrame:
    """Every bar as the last batch that changed it left it."""
    rows = spark.read.option("mergeSchema", "false").parquet(out)
    return (rows.groupBy(CODE, "start").agg(F.max_by(F.struct(*VALUES), "batch").alias("x"))
            .select(CODE, "start", "x.*"))
