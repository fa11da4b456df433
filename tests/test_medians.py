"""Medians by selection against a sort."""

import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE, lay_out
from tidemark.operators import medians, selection
from tidemark.operators.medians import median_by_selection

SHAPES = {
    "even": [float(i * 7919 % 10_007) for i in range(10_000)],
    "odd": [float(i * 7919 % 10_007) for i in range(9_999)],
    "tail": [1.3 ** (i % 2000) for i in range(6_001)],
    "mostly_one": [5.0] * 8_000 + [float(i) for i in range(1_000)],
    "edge_of_one": [5.0] * 3_000 + [6.0 + i / 7 for i in range(3_000)],
    "one": [4.0],
    "two": [1.0, 2.0],
    "negative": [-float(i) for i in range(500)],
    "infinite": [float("inf")] * 3 + [float("-inf")] * 400 + [float(i) for i in range(400)],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, x) for k, v in SHAPES.items() for x in v]
    rows += [(None, 1.0), ("empty", None), ("empty", float("nan")), ("two", None), ("one", float("nan"))]
    return spark.createDataFrame(rows, "k string, x double").repartition(7).cache()


@pytest.mark.parametrize("most, bins", [(16, 4), (256, 64), (65_536, 64)])
def test_equals_a_sort(values, most, bins):
    got = {r.k: r.m for r in median_by_selection(values, "k", "x", "m", most, bins).collect()}
    assert got == {k: statistics.median(v) for k, v in SHAPES.items()}


def test_a_task_sorts_few_values(values, monkeypatch):
    """The values that are sorted at the end, of every code, a hot one included."""
    seen = []
    middle = medians._middle
    monkeypatch.setattr(medians, "_middle", lambda c, *more: (seen.append(c), middle(c, *more))[1])
    median_by_selection(values, "k", "x", "m", 64, 16).collect()
    held = {r.k: r["count"] for r in seen[0].groupBy("k").count().collect()}
    assert held.keys() == SHAPES.keys() and max(held.values()) <= 64


def test_series_in_slabs_and_limits(spark, price_schema, values):
    rows = [(c, None, 1.0, 1.0, 1.0, 1.0, float(i * 31 % 977)) for c, n in (("hot", 4000), ("b", 301)) for i in range(n)]
    table = spark.createDataFrame(rows, price_schema).withColumn("date", F.to_date(F.lit("2020-01-01")) + (F.col("volume") % 700).cast("int"))
    cut = lay_out(table, rows_per_slab=1500)
    a, b = ({r[CODE]: r.median_volume for r in selection.median_volume(t).collect()} for t in (table, cut))
    assert a == b and len(a) == 2
    assert median_by_selection(values.limit(0), "k", "x").count() == 0
    with pytest.raises(ValueError):
        median_by_selection(values, "k", "x", most=10, bins=4)
