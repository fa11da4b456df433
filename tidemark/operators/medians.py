"""Exact medians where one code may hold any share of all rows: selection instead of a sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Distinct values of one code that a task may sort at the end, and bins of a pass.
MOST_VALUES, BINS = 65_536, 64


def median_by_selection(rows: DataFrame, key: str, value: str, into: str = "median",
                        most: int = MOST_VALUES, bins: int = BINS) -> DataFrame:
    """``key`` and the exact median of ``value``, a mean of the two middle ones for an even count.

    Equal values are counted once, before the shuffle. Then bins of about as many distinct
    values each, whose edges come from a mergeable sketch, are laid over the values of each
    code; the rows of each bin are summed, and only the one or two bins that hold the middle
    go on, until a code has at most ``most`` distinct values left. A pass leaves about
    2 / ``bins`` of the values, whatever their distribution and however often one repeats,
    so 10^12 distinct values take five passes. Sums decide, so the edges need not be exact.
    Rows whose key or value is missing (null or NaN) take no part; a code without values gets
    no row; infinite values rank as any others."""
    if bins < 4 or most < 4 * bins:
        raise ValueError("bins must be four or more, and a task must hold four times as many values")
    v = F.col(value).cast("double")
    counts = (rows.where(F.col(key).isNotNull() & v.isNotNull() & ~F.isnan(v))
              .groupBy(F.col(key), v.alias("value")).agg(F.count(F.lit(1)).alias("rows")))
    counts = stored(counts, "median-counts")
    known = counts.groupBy(key).agg(F.sum("rows").alias("known"))
    # ranks of the two middle rows among the rows that are left
    left = counts.join(known.select(key, F.floor((F.col("known") + 1) / 2).alias("low"),
                                    (F.floor(F.col("known") / 2) + 1).alias("high")), key)
    grid = [i / bins for i in range(1, bins)]
    small = []
    while True:
        kinds = left.groupBy(key).agg(
            F.count(F.lit(1)).alias("kinds"),
            F.percentile_approx("value", grid, bins * 100).alias("edges"))
        kinds = stored(kinds, "median-edges")
        small.append(left.join(kinds.where(F.col("kinds") <= most).select(key), key, "left_semi"))
        over = kinds.where(F.col("kinds") > most)
        if over.isEmpty():
            break
        binned = left.join(over.select(key, "edges"), key).withColumn(
            "bin", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges")
        # a row a bin
        up = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = (binned.groupBy(key, "bin", "low", "high").agg(F.sum("rows").alias("in_bin"))
                .withColumn("upto", F.sum("in_bin").over(up)))
        before = F.col("upto") - F.col("in_bin")
        kept = sums.where((F.col("upto") >= F.col("low")) & (before < F.col("high")))
        first = F.min(before).over(Window.partitionBy(key))
        kept = kept.select(key, "bin", (F.col("low") - first).alias("low"),
                           (F.col("high") - first).alias("high"))
        left = stored(binned.drop("low", "high").join(kept, [key, "bin"]).drop("bin"), "median-left")
    return _middle(reduce(DataFrame.unionByName, small), key, into)


def _middle(counts: DataFrame, key: str, into: str) -> DataFrame:
    up = Window.partitionBy(key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("rows").over(up))
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("rows") < rank)
    one, two = (F.max(F.when(holds(F.col(r)), F.col("value"))) for r in ("low", "high"))
    return ranked.groupBy(key).agg(((one + two) / 2).alias(into))
