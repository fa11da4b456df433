"""Exponentially weighted averages without recursion and without Python.

With ``a = 2 / (span + 1)`` and ``q = 1 - a`` the average is a sum of past values
weighted by powers of ``q``. The series is cut into blocks so short that ``q`` to the
power of a block position stays a normal double, and so long that ``q`` to the power of
a whole block is below 1e-20: the sum inside a row's block plus what the block before it
ended with is then the average to the last bit that a double holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import check_margins, memory_rows, series_keys, series_window


@dataclass(frozen=True)
class Ewm:
    value: str
    span: int
    adjust: bool

    @property
    def q(self) -> float:
        return 1.0 - 2.0 / (self.span + 1.0)


def block_rows(spans) -> int:
    """Block length shared by these spans, all above 1."""
    return memory_rows(max(spans))


def share_blocks(spans) -> bool:
    """Whether the powers of the narrowest span stay normal doubles over the blocks that the
    widest one needs."""
    narrowest = min(spans)
    return narrowest > 1 and -block_rows(spans) * math.log(1.0 - 2.0 / (narrowest + 1.0)) <= 690


def passes(averages: dict[str, Ewm]) -> list[dict[str, Ewm]]:
    """The averages in groups that can share blocks, the widest spans first."""
    groups: list[dict[str, Ewm]] = []
    for name, e in sorted(averages.items(), key=lambda x: -x[1].span):
        if groups and share_blocks([e.span, *[o.span for o in groups[-1].values()]]):
            groups[-1][name] = e
        else:
            groups.append({name: e})
    return groups


def with_blocks(df: DataFrame, rows: int) -> DataFrame:
    at = F.row_number().over(series_window(df)) - 1
    return df.withColumn("_at", at).withColumns({
        "_block": F.floor(F.col("_at") / rows).cast("int"),
        "_in": F.col("_at") % rows,
    })


def add_ewm(df: DataFrame, averages: dict[str, Ewm]) -> DataFrame:
    """Adds the averages to a table prepared by :func:`with_blocks`."""
    keys = series_keys(df)
    inside = (Window.partitionBy(*keys, "_block").orderBy("_in")
              .rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1)
    at = F.col("_in").cast("double")

    def inner(e: Ewm) -> Column:
        x = F.col(e.value)
        z = x if e.adjust else F.when(F.col("_at") == 0, x).otherwise(x * F.lit(1.0 - e.q))
        return F.pow(F.lit(e.q), at) * F.sum(z * F.pow(F.lit(e.q), -at)).over(inside)

    def whole(name: str, e: Ewm) -> Column:
        carried = F.coalesce(F.max_by(f"_{name}", "_in").over(before), F.lit(0.0))
        total = F.col(f"_{name}") + carried * F.pow(F.lit(e.q), at + 1)
        if not e.adjust:
            return total
        weights = (1 - F.pow(F.lit(e.q), F.col("_at") + 1)) / F.lit(1.0 - e.q)
        return total / weights

    return (
        df.withColumns({f"_{name}": inner(e) for name, e in averages.items()})
        .withColumns({name: whole(name, e) for name, e in averages.items()})
        .drop(*[f"_{name}" for name in averages])
    )


def ewm(df: DataFrame, averages: dict[str, Ewm]) -> DataFrame:
    """Adds several averages, those of like spans in one pass over the series. A span of 1
    gives the values themselves."""
    if any(e.span < 1 for e in averages.values()):
        raise ValueError("a span must be at least 1")
    check_margins(df, max((memory_rows(e.span) for e in averages.values()), default=0))
    df = df.withColumns({name: F.col(e.value) for name, e in averages.items() if e.span == 1})
    for group in passes({name: e for name, e in averages.items() if e.span > 1}):
        blocked = with_blocks(df, block_rows([e.span for e in group.values()]))
        df = add_ewm(blocked, group).drop("_at", "_block", "_in")
    return df


def macd(df: DataFrame, close: str = "close", fast: int = 12, slow: int = 26,
         signal: int = 9, adjust: bool = False, also: dict[str, Ewm] | None = None) -> DataFrame:
    """Adds ``macd`` and ``macd_signal``; ``also`` are averages taken in the same pass where
    their spans allow it."""
    own = {"_fast": Ewm(close, fast, adjust), "_slow": Ewm(close, slow, adjust)}
    after = {"macd_signal": Ewm("macd", signal, adjust)}
    spans, rest = [fast, slow, signal], dict(also or {})
    if not share_blocks(spans):
        out = ewm(df, {**own, **rest}).withColumn("macd", F.col("_fast") - F.col("_slow"))
        return ewm(out.drop("_fast", "_slow"), after)
    for name, e in (also or {}).items():
        if share_blocks([*spans, e.span]):
            own[name] = rest.pop(name)
            spans.append(e.span)
    check_margins(df, max(memory_rows(max(fast, slow)) + memory_rows(signal), memory_rows(max(spans))))
    out = add_ewm(with_blocks(df, block_rows(spans)), own)
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(add_ewm(out, after).drop("_at", "_block", "_in"), rest)
