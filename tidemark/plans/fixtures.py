"""Price, list and raw-file tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import CODE, TASK_ROWS, parts_of
from ..operators.cleaning import norm_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument per supplier, one bar per ship date. The aggregate is combined
    before the shuffle, so the rows of a busy supplier collapse to its days early."""
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    k = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return (
        li.where("l_quantity <> 0")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by(px, k).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
             F.max_by(px, k).alias("close"), F.sum("l_quantity").alias("volume"))
        .select(norm_code(F.col("l_suppkey")).alias(CODE),
                "date", "open", "high", "low", "close", "volume")
    )


def bars_by_code(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """The bars shuffled by code for operators on whole series, in as many partitions as the rows, and
    the ``copies`` that are made of each, ask for: what a task sorts and holds does not grow with the table."""
    parts = parts_of(bar_rows(spark, sf_dir) * copies, spark.sparkContext.defaultParallelism, TASK_ROWS)
    return bars(spark, sf_dir).repartition(parts, CODE)


def bar_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many rows the bars have at most."""
    return table(spark, sf_dir, "lineitem").count()


def stock_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"),
                F.col("n_name").alias("industry_name"), F.col("r_name").alias("market_name"))
    )


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as text under capitalised headers, with the faults that files have."""
    n = F.col(CODE).cast("long") + F.unix_date("date")
    text = lambda c: F.col(c).cast("string")
    return bars(spark, sf_dir).select(
        F.col(CODE).cast("long").cast("string").alias("Code"),
        F.when(n % 97 == 0, "2025-13-01").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("Date"),
        F.when(n % 89 == 0, "abc").otherwise(text("open")).alias("Open"),
        F.when(n % 83 == 0, (F.col("low") * 0.5).cast("string")).otherwise(text("high")).alias("High"),
        text("low").alias("Low"),
        F.when(n % 79 != 0, text("close")).alias("Close"),
        F.when(n % 73 != 0, text("volume")).alias("Volume"),
    )
