"""Windows over price series, and how a series is cut so that no task holds a whole one.

Two layouts of a price table are supported by the same operators:

* **daily** - one row per (stock_code, date), date a DATE. A series is then never longer
  than its calendar (about 25,000 trading days in a century), so a window per code is
  bounded whatever the total size. Windows are ``partitionBy(stock_code).orderBy(date)``.
* **slabs** - made by :func:`lay_out` for tables with repeated dates or intraday
  timestamps, where one code may hold any share of the rows. Each series is cut by row
  position into slabs of bounded length; each slab also gets the last rows of the slab
  before and the first rows of the slab after it. Windows are
  ``partitionBy(stock_code, slab).orderBy(pos)``; :func:`settle` drops the copies again.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE = "stock_code"
TIES = ("open", "high", "low", "close", "volume")

# Rows a slab carries from its neighbours at least. Behind: the longest chain of indicators
# with the default windows (an exponential average of span 26 smoothed by span 9 forgets
# 1e-20 of itself within 850 rows; every other one looks back at most 120). Ahead: forward
# returns look 25 rows on. Wider windows ask for wider margins, see ``margins``.
BEHIND = 1024
AHEAD = 64
FORGOTTEN = 1e-20

# Rows of a task that holds whole series or slabs, about.
TASK_ROWS = 1 << 18


def parts_of(rows: int, least: int, each: int = TASK_ROWS) -> int:
    """Partitions for so many rows. The runtime would coalesce partitions by the bytes that were
    shuffled, of which a price row has few; the sorts that follow hold many times as many."""
    return max(least, -(-rows // each))


def memory_rows(span: int) -> int:
    """Rows after which an exponential average of this span has forgotten all that a double
    can tell."""
    return 0 if span < 2 else math.ceil(math.log(FORGOTTEN) / math.log(1.0 - 2.0 / (span + 1.0)))


def spread_rows(p) -> int:
    """Rows behind a row that its indicators look at, exponential averages apart."""
    return p.long_window + p.volatility_window + 50 + 25


def margins(p, lookback: int = 0) -> tuple[int, int]:
    """The margins behind and ahead that all operators need with these windows."""
    averages = max(map(memory_rows, (p.short_window, p.long_window)))
    return max(BEHIND, averages, spread_rows(p), lookback + 1), max(AHEAD, p.long_window)


def check_margins(df: DataFrame, behind: int, ahead: int = 0) -> None:
    """Refuses a table whose slabs carry fewer rows than an operator looks at."""
    if not is_sliced(df):
        return
    told = df.schema["slab"].metadata
    if told.get("behind", BEHIND) < behind or told.get("ahead", AHEAD) < ahead:
        raise ValueError(f"lay_out with margins of {behind} and {ahead} rows or more (see margins)")


def is_sliced(df: DataFrame) -> bool:
    return "slab" in df.columns


def slab_rows(df: DataFrame) -> int | None:
    """Rows that a slab does not share with its neighbours; None of a daily table."""
    return df.schema["slab"].metadata.get("rows") if is_sliced(df) else None


def series_keys(df: DataFrame) -> list[str]:
    return [CODE] + [c for c in ("slab", "member") if c in df.columns]


def keys_of(df: DataFrame) -> list[str]:
    return [CODE] + (["member"] if "member" in df.columns else [])


def series_window(df: DataFrame):
    """The window every trailing operator runs on. Rows of one date stand in the order of
    their figures, so that the order of the input does not matter."""
    return Window.partitionBy(*series_keys(df)).orderBy(*series_order(df))


def series_order(df: DataFrame) -> list[str]:
    if "pos" in df.columns:
        return ["pos"]
    if not isinstance(df.schema["date"].dataType, T.DateType):
        raise ValueError("a series with times of day must be laid out first (lay_out)")
    return ["date", *ties(df)]


def ties(df: DataFrame) -> list[str]:
    return [c for c in TIES if c in df.columns]


def trailing(w, rows: int):
    return w.rowsBetween(1 - rows, 0)


def full_window(agg, x: Column, w, rows: int) -> Column:
    """``agg`` over the last ``rows`` rows, NULL until all of them are there.

    The count shares its frame with the aggregate, so both see each row once."""
    frame = trailing(w, rows)
    value = F.sum(x).over(frame) / F.lit(float(rows)) if agg is F.avg else agg(x).over(frame)
    return F.when(F.count(x).over(frame) == rows, value)


def reaches_back(w, rows: int) -> Column:
    """Whether the series has at least ``rows`` rows up to this one."""
    return F.lag(F.lit(1), rows - 1).over(w).isNotNull()


def prior(x: Column | str, w, rows: int = 1) -> Column:
    return F.lag(x, rows).over(w)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def slope_of_last(y: Column, w, rows: int, at_least: int | None = None) -> Column:
    """Least-squares slope of the last ``rows`` values on 0, 1, 2, ...

    With ``at_least`` the fit falls back to fewer values where the series has not more;
    otherwise it is NULL there. Missing values may stand at the head of a series only."""
    at_least = at_least or rows
    back = [y] + [prior(y, w, k) for k in range(1, rows)]
    fits = []
    for m in range(rows, at_least - 1, -1):
        spread = m * (m * m - 1) / 12.0
        terms = [back[k] * F.lit(((m - 1) / 2.0 - k) / spread) for k in range(m)
                 if (m - 1) / 2.0 != k]
        fits.append(F.when(back[m - 1].isNotNull(), reduce(lambda a, b: a + b, terms)))
    return F.coalesce(*fits)


def position_columns(df: DataFrame) -> dict[str, Column]:
    """``pos`` (0-based row in the series) and ``n`` (length of the series), unless there."""
    if "pos" in df.columns:
        return {}
    return {
        "pos": (F.row_number().over(series_window(df)) - 1).cast("long"),
        "n": F.count(F.lit(1)).over(Window.partitionBy(CODE)),
    }


def with_position(df: DataFrame) -> DataFrame:
    return df.withColumns(position_columns(df))


def place(prices: DataFrame) -> DataFrame:
    """``pos`` and ``n`` without ever sorting a whole series in one task.

    Rows are counted per (code, span of time) with map-side combine, the counts are
    summed up along each code (one row per span), and each row's place is its span's
    start plus its rank inside the span. Equal dates are ordered by the prices."""
    whole_days = isinstance(prices.schema["date"].dataType, T.DateType)
    span = F.trunc("date", "month") if whole_days else F.date_trunc("hour", "date")
    prices = prices.withColumn("span", span)
    sizes = prices.groupBy(CODE, "span").agg(F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy(CODE).orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(
        CODE, "span",
        (F.sum("rows").over(along) - F.col("rows")).alias("start"),
        F.sum("rows").over(Window.partitionBy(CODE)).alias("n"),
    )
    inside = Window.partitionBy(CODE, "span").orderBy("date", *ties(prices))
    return (
        prices.withColumn("rank", F.row_number().over(inside))
        .join(starts.hint("merge"), [CODE, "span"])
        .withColumn("pos", F.col("start") + F.col("rank") - 1)
        .drop("span", "rank", "start")
    )


def slab_of(pos: str, rows_per_slab: int) -> Column:
    return F.expr(f"{pos} div {int(rows_per_slab)}")


def lay_out(prices: DataFrame, rows_per_slab: int = 65536,
            behind: int = BEHIND, ahead: int = AHEAD, p=None, rows: int | None = None) -> DataFrame:
    """Cuts every series into slabs of ``rows_per_slab`` rows plus their margins, which the
    parameters ``p`` widen to what their windows need. Of a table of about ``rows`` rows, copies in
    margins apart, there are so many partitions that a task's rows do not grow with it.

    The result is partitioned by code and slab on purpose: a partitioning by code alone
    would satisfy the windows as well, and would put a whole series into one task."""
    if p is not None:
        behind, ahead = map(max, (behind, ahead), margins(p, p.lookback))
    if rows_per_slab < behind + ahead:
        raise ValueError("a slab must be longer than its two margins")
    copied = None if rows is None else rows * (rows_per_slab + behind + ahead) // rows_per_slab
    parts = [] if rows is None else [parts_of(copied, prices.sparkSession.sparkContext.defaultParallelism)]
    at = F.col("pos") % rows_per_slab
    own = slab_of("pos", rows_per_slab)
    slabs = F.array_compact(F.array(
        own,
        F.when(at >= rows_per_slab - behind, own + 1),
        F.when((at < ahead) & (own > 0), own - 1),
    ))
    return (
        place(prices)
        .withColumn("slab", F.explode(slabs))
        .withColumns({
            "home": F.col("slab") == own,
            "late": at >= rows_per_slab - behind,
        })
        .where(F.col("home") | (F.col("slab") * rows_per_slab < F.col("n")))
        .repartition(*parts, CODE, "slab")
        .withMetadata("slab", {"behind": behind, "ahead": ahead, "rows": rows_per_slab, **({"parts": parts[0]} if parts else {})})
    )


def settle(df: DataFrame) -> DataFrame:
    """Keeps each row once, in its own slab; a daily table passes unchanged."""
    return df.where("home").drop("slab", "home", "late") if is_sliced(df) else df


def with_neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Adds ``prev`` and ``next``: these columns of the row before and after in the whole
    series, for a sparse table that kept its ``slab``.

    Windows stay inside a slab; for a slab's first and last row the answer is looked up
    among the ends of the slabs, of which there is one per tens of thousands of rows."""
    row = F.struct(*cols)
    inside = Window.partitionBy(*keys, "slab").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("slab")
    ends = df.groupBy(*keys, "slab").agg(F.min_by(row, order).alias("first"),
                                         F.max_by(row, order).alias("last"))
    ends = ends.select(*keys, "slab", F.lag("last").over(across).alias("_prev"),
                       F.lead("first").over(across).alias("_next"))
    return df.withColumns({
        "prev": F.lag(row).over(inside), "next": F.lead(row).over(inside),
    }).join(ends.hint("merge"), [*keys, "slab"]).withColumns({
        "prev": F.coalesce("prev", "_prev"), "next": F.coalesce("next", "_next"),
    }).drop("_prev", "_next")


def recency(df: DataFrame) -> DataFrame:
    """Adds ``rd``: 1 for the last row of a series, 2 for the one before, ..."""
    return with_position(df).withColumn("rd", F.col("n") - F.col("pos"))


def last_rows(prices: DataFrame, rows: int) -> DataFrame:
    """The last rows of each series with their ``rd``.

    A ``row_number() <= k`` filter is applied by Spark before the shuffle as well, so a
    task sends at most ``rows`` rows per code, however long the series is."""
    if "pos" in prices.columns:
        return settle(recency(prices)).where(F.col("rd") <= rows)
    w = Window.partitionBy(CODE).orderBy(*[F.col(c).desc() for c in series_order(prices)])
    return prices.withColumn("rd", F.row_number().over(w)).where(F.col("rd") <= rows)


def tail(prices: DataFrame, rows: int) -> DataFrame:
    """The last rows of each series as series of their own, with their ``pos`` and ``n``."""
    df = last_rows(prices, rows).drop("pos", "n")
    df = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(CODE)))
    return df.withColumn("pos", (F.col("n") - F.col("rd")).cast("long")).drop("rd")
