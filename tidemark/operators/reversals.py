"""Peaks and troughs of the moving averages, and what they say about the next one."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import (CODE, is_sliced, keys_of, position_columns, prior, series_window,
                                slab_of, ties, with_neighbours)
from ..params import KINDS, TrendParams
from ..session import workspace
from ..sources.tables import stored
from .indicators import DEFAULT, ensure_ma, ma_columns
from .selection import union_sources


# Positions per slab of the tables of extremes and reversals of a sliced series.
SPAN = 65536


def extremes(prices: DataFrame, p: TrendParams, kind: str) -> DataFrame:
    """Strict local extremes of the moving average; a plateau counts at its middle row,
    the two ends of a series never count."""
    if is_sliced(prices):
        return sliced_extremes(prices, p, kind)
    window, ma = p.window(kind), F.col(f"ma_{p.window(kind)}")
    up, keys = series_window(prices), keys_of(prices)
    df = prices.withColumns({**position_columns(prices), **ma_columns(prices, p, (kind,))})
    df = df.select(*keys, "date", "close", *[c for c in ties(prices) if c != "close"], "pos", "n",
                   ma.alias("v"))
    df = df.where(F.col("v").isNotNull() & (F.col("n") - window + 1 >= 2 * window))

    left, right = F.lag("v").over(up), F.lead("v").over(up)
    df = df.withColumns({"left": left, "right": right})
    starts = F.col("left").isNull() | (F.col("left") != F.col("v"))
    ends = F.col("right").isNull() | (F.col("right") != F.col("v"))
    since = F.when(starts, F.struct(F.col("pos").alias("at"), F.col("left").alias("v")))
    df = df.withColumns({
        "single": starts & ends,
        "ends": ends,
        "from": F.last(since, ignorenulls=True).over(
            up.rowsBetween(Window.unboundedPreceding, 0)),
    })
    turns = (F.col("left") - F.col("v")) * (F.col("right") - F.col("v")) > 0
    df = df.where(~F.col("single") | turns)

    down = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    until = F.when(F.col("ends"), F.struct(F.col("pos").alias("at"), F.col("right").alias("v")))
    df = df.withColumn("to", F.last(until, ignorenulls=True).over(
        down.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.floor((F.col("from.at") + F.col("to.at")) / 2)
    kind_of = (F.when((F.col("from.v") < F.col("v")) & (F.col("to.v") < F.col("v")), "peak")
               .when((F.col("from.v") > F.col("v")) & (F.col("to.v") > F.col("v")), "trough"))
    return (df.where(F.col("pos") == middle).withColumn("type", kind_of)
            .where(F.col("type").isNotNull())
            .select(*keys, "type", "date", "pos", "v", "close"))


def sliced_extremes(prices: DataFrame, p: TrendParams, kind: str) -> DataFrame:
    """The same for a series in slabs: the first rows of all plateaus (single rows mostly)
    meet their neighbours across slabs; a long plateau's middle row is looked up."""
    window, ma = p.window(kind), F.col(f"ma_{p.window(kind)}")
    df = ensure_ma(prices, p)
    before = prior(ma, series_window(df))
    df = df.select(CODE, "slab", "home", "date", "close", "pos", "n", ma.alias("v"),
                   before.alias("before"))
    df = df.where(F.col("home") & F.col("v").isNotNull()
                  & (F.col("n") - window + 1 >= 2 * window))
    starts = df.where(F.col("before").isNull() | (F.col("before") != F.col("v")))
    runs = with_neighbours(starts, [CODE], "pos", ["pos", "v"])
    v, left, right = F.col("v"), F.col("prev.v"), F.col("next.v")
    kind_of = (F.when((left < v) & (right < v), "peak")
               .when((left > v) & (right > v), "trough"))
    runs = runs.select(CODE, kind_of.alias("type"), "date", "close", "v", "pos",
                       F.expr("(pos + next.pos - 1) div 2").alias("middle"))
    runs = runs.where(F.col("type").isNotNull())
    out = [CODE, "type", "date", "pos", "v", "close"]
    single = runs.where("middle = pos").select(*out)
    middles = runs.where("middle <> pos").select(CODE, "type", F.col("middle").alias("pos"))
    inside = df.where(F.col("before") == F.col("v"))  # a row behind the first one of its plateau
    wide = middles.join(inside.select(CODE, "pos", "date", "v", "close"), [CODE, "pos"])
    return single.unionByName(wide.select(*out)).withColumn("slab", slab_of("pos", SPAN))


def with_tops(found: DataFrame, distance: int) -> DataFrame:
    """Adds ``top``, ``beaten`` and ``stretch`` (the position of the last top so far)."""
    order = Window.partitionBy(*keys_of(found), "type").orderBy("pos")
    near = order.rangeBetween(1 - distance, distance - 1)
    top = F.max(F.struct("h", "pos")).over(near)["pos"] == F.col("pos")
    found = found.withColumn("top", top).withColumn(
        "beaten", ~F.col("top") & F.max("top").over(near))
    top_at = F.when(F.col("top"), F.col("pos"))
    return found.withColumn("stretch", F.coalesce(F.max(top_at).over(
        order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))


def keep_apart(found: DataFrame, distance: int) -> DataFrame:
    """Drops extremes closer than ``distance`` to a higher one that is kept itself
    (highest first, the later one first among equals).

    An extreme that is the highest within ``distance`` on both sides is certainly kept and
    certainly removes its neighbours, so nothing acts across it: the series falls apart
    into short independent stretches and only those are folded, each by itself. A series in
    slabs, whose stretches may be of any length, is decided slab by slab in rounds."""
    if distance <= 2:  # two strict extremes of one type are never closer than that
        return stored(found, "extremes") if is_sliced(found) else found
    height = F.when(F.col("type") == "peak", F.col("v")).otherwise(-F.col("v"))
    found = found.withColumn("h", height)
    if is_sliced(found):
        return keep_apart_in_rounds(found, distance).drop("h")
    found, keys = with_tops(found, distance), keys_of(found)
    stretch = found.where(~F.col("beaten")).groupBy(*keys, "type", "stretch").agg(
        F.sort_array(F.collect_list(F.struct("h", "pos", "date", "v", "close")), asc=False)
        .alias("all"))
    clear = lambda kept, x: ~F.exists(kept, lambda k: F.abs(k["pos"] - x["pos"]) < distance)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(
        clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return (stretch.select(*keys, "type", F.explode(kept).alias("x"))
            .select(*keys, "type", "x.date", "x.pos", "x.v", "x.close"))


# What is known of an extreme: a lower one that was not looked at yet, or a dropped one, acts on none.
SILENT, KEPT, OPEN = 0, 1, 2


def _decide(distance: int):
    """What a slab alone can say of its own extremes, highest first: one near a kept one goes, one
    near a higher one that another slab has yet to decide stays open, any other one is kept."""
    def decide(table: pa.Table) -> pa.Table:
        pos, h = table.column("pos").to_numpy(), table.column("h").to_numpy()
        order = np.argsort(pos, kind="stable")
        pos, h = pos[order], h[order]
        own, kept = (table.column(c).to_numpy()[order] for c in ("own", "kept"))
        start, end = np.searchsorted(pos, pos - distance, "right"), np.searchsorted(pos, pos + distance)
        state = np.zeros(len(pos), np.int8)
        for i in np.lexsort((pos, h))[::-1]:
            if kept[i]:
                state[i] = KEPT
            elif not own[i]:
                state[i] = OPEN
            else:
                near = state[start[i]:end[i]]
                state[i] = SILENT if (near == KEPT).any() else OPEN if (near == OPEN).any() else KEPT
        told = own & ~kept & (state != SILENT)
        rows = table.drop_columns(["own", "kept"]).take(pa.array(order[told]))
        return rows.append_column("state", pa.array(state[told].astype(np.int32)))
    return decide


def keep_apart_in_rounds(found: DataFrame, distance: int) -> DataFrame:
    """``keep_apart`` for a series in slabs of ``SPAN`` positions. A slab sees its own extremes and those of
    its neighbours within ``distance`` of the border. What hangs on a neighbour's open ones waits
    for the next round, to which only open extremes and kept ones at a border go on. The
    highest open extreme is decided in each round, and with it all that hangs on it within its
    slab: a chain over many slabs takes a round a slab, and no task holds more than one."""
    spark, root = found.sparkSession, workspace(found.sparkSession, "kept-apart")
    columns = found.columns
    schema = T.StructType([*found.schema.fields, T.StructField("state", T.IntegerType())])
    at = F.col("pos") % SPAN
    before, after = at < distance, at >= SPAN - distance
    play = found.withColumn("kept", F.lit(False))
    for step in itertools.count():
        copies = F.array_compact(F.array(
            F.struct(F.col("slab").alias("to"), F.lit(True).alias("own")),
            F.when(before, F.struct((F.col("slab") - 1).alias("to"), F.lit(False).alias("own"))),
            F.when(after, F.struct((F.col("slab") + 1).alias("to"), F.lit(False).alias("own")))))
        near = play.withColumn("copy", F.explode(copies)).withColumns({"slab": F.col("copy.to"), "own": F.col("copy.own")}).drop("copy")
        told = near.groupBy(CODE, "type", "slab").applyInArrow(_decide(distance), schema)
        told.write.parquet(f"{root}/step={step}")
        done = spark.read.schema(schema).parquet(f"{root}/step={step}")
        if done.where(F.col("state") == OPEN).isEmpty():
            break
        kept = F.col("state") == KEPT
        play = done.where(~kept | before | after).withColumn("kept", kept).drop("state")
    return spark.read.schema(schema).parquet(f"{root}/*").where(F.col("state") == KEPT).select(*columns)


def reversals(prices: DataFrame, kind: str = "short", p: TrendParams = DEFAULT) -> DataFrame:
    """One row per reversal of the chosen trend; of a sliced series with its ``slab``."""
    kept = keep_apart(extremes(prices, p, kind), p.window(kind) // 2)
    peak = F.col("type") == "peak"
    return kept.select(
        *keys_of(kept), F.lit(kind).alias("trend_type"), "date", F.col("pos").alias("idx"), "type",
        F.col("v").alias("price"), F.col("close").alias("actual_price"),
        F.when(peak, "+").otherwise("-").alias("trend_before"),
        F.when(peak, "-").otherwise("+").alias("trend_after"),
        *(["slab"] if is_sliced(kept) else []))


def all_reversals(prices: DataFrame, p: TrendParams = DEFAULT) -> DataFrame:
    return union_sources(*[reversals(prices, k, p) for k in KINDS])


def with_steps(found: DataFrame) -> DataFrame:
    """Adds the gap in days and the step in price from the reversal before."""
    if is_sliced(found):
        near = with_neighbours(found, [CODE, "trend_type"], "idx", ["date", "price"])
        day, price = F.col("prev.date"), F.col("prev.price")
    else:
        order = Window.partitionBy(*keys_of(found), "trend_type").orderBy("idx")
        near, day, price = found, F.lag("date").over(order), F.lag("price").over(order)
    return near.withColumns({
        "gap": F.datediff("date", day), "step": F.abs(F.col("price") - price),
    }).drop("prev", "next")


def recent_reversals(found: DataFrame, rows: int = 3) -> DataFrame:
    """The latest reversals with their rank ``k``; cut down before the shuffle."""
    last = Window.partitionBy(*keys_of(found), "trend_type").orderBy(F.col("idx").desc())
    df = found.withColumn("k", F.row_number().over(last)).where(F.col("k") <= rows)
    return df.withColumn("k", F.col("k").cast("long"))


def reversal_stats(found: DataFrame, last: int = 5) -> DataFrame:
    """All that the forecasts need to know about a code's reversals, one row per code (and member): the
    rhythm of all of them, and size, price and details of the last ones."""
    told = F.struct("idx", "date", "type", "price", "actual_price", "trend_before", "trend_after")
    of_all = {
        "reversal_count": F.count(F.lit(1)),
        "gap_mean": F.avg("gap"), "gap_std": F.stddev_pop("gap"),
        "last_price": F.max_by(F.col("price"), F.col("idx")),
    }
    of_last = {
        "avg_magnitude": F.avg(F.when(F.col("k") <= last - 1, F.col("step"))),
        "recent": F.sort_array(F.collect_list(F.when(F.col("k") <= 3, told))),
    }
    made = lambda df, aggs: df.groupBy(*keys, "trend_type").agg(
        *[a.alias(name) for name, a in aggs.items()])
    stepped, keys = with_steps(found), keys_of(found)
    if is_sliced(found):
        latest = recent_reversals(stepped, max(last - 1, 3))
        return made(stepped, of_all).join(made(latest, of_last), [*keys, "trend_type"])
    whole = Window.partitionBy(*keys, "trend_type")
    rank = F.count(F.lit(1)).over(whole) - F.row_number().over(whole.orderBy("idx")) + 1
    return made(stepped.withColumn("k", rank), {**of_all, **of_last})


def reversal_magnitude(found: DataFrame, last: int = 5) -> DataFrame:
    """Mean absolute price step over the last reversals (one step fewer than those)."""
    return reversal_stats(found, last).select(
        CODE, "trend_type", "reversal_count", "avg_magnitude")
