"""Moments of batches, merged, against those of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import features, moments
from tidemark.operators.moments import add_batch, moments as moments_of, scaler_of, stored_moments, wide_scaler


@pytest.fixture(scope="module")
def prices(price_table):
    rng = np.random.default_rng(9)
    # large values with small deviations, and a series that never changes
    made = {f"_{i:05d}": (1e7 + rng.normal(0, 1e-2, 90 + i)).tolist() for i in range(4)}
    return price_table(**made, _00009=[5.0] * 30).withColumn("volume", F.when(F.dayofyear("date") % 9 != 0, F.col("close") * 3))


COLS = ["open", "close", "volume"]


def test_merged_equals_whole(spark, prices, tmp_path):
    store = str(tmp_path / "moments")
    cut = prices.withColumn("b", F.floor(F.dayofyear("date") / 20).cast("int"))
    for b in range(6):
        add_batch(cut.where(F.col("b") == b).drop("b"), store, b, COLS)
    add_batch(cut.where("b = 3").drop("b"), store, 3, COLS)  # replayed
    told = {(r[CODE], r.feature): r for r in scaler_of(stored_moments(spark, store)).collect()}
    want = features.scaler_params(prices, COLS).collect()
    assert len(told) == len(want) == 15
    for r in want:
        got = told[r[CODE], r.feature]
        assert got.mean == pytest.approx(r["mean"], rel=1e-9) and got.scale == pytest.approx(r.scale, rel=1e-6)
    assert told["00009", "close"].scale == 1.0
    again = features.scale_features(prices, wide_scaler(scaler_of(stored_moments(spark, store)), COLS), COLS)
    whole = features.scale_features(prices, cols=COLS)
    key = lambda df: [r.close for r in df.orderBy(CODE, "date").collect()]
    assert key(again) == pytest.approx(key(whole), rel=1e-4, abs=1e-4)


def test_an_update_reads_the_new_rows_alone(spark, prices, tmp_path):
    """The renewed scaler's plan scans moments, and a batch's moments scan that batch."""
    old, new, store = (str(tmp_path / n) for n in ("old", "new", "store"))
    prices.where("dayofyear(date) < 50").write.parquet(old)
    prices.where("dayofyear(date) >= 50").write.parquet(new)
    add_batch(spark.read.parquet(old), store, 0, COLS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    batch = plan(moments_of(spark.read.parquet(new), COLS))
    assert "/new" in batch and "/old" not in batch and "partial_" in batch
    add_batch(spark.read.parquet(new), store, 1, COLS)
    after = plan(scaler_of(stored_moments(spark, store)))
    assert "/store" in after and "/old" not in after and "/new" not in after


def test_values_that_are_missing(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", 2.0, None)], "stock_code string, x double, y double")
    out = {(r[CODE], r.feature): (r.n, r["mean"], r.squares) for r in moments_of(df, ["x", "y"]).collect()}
    assert out == {("a", "x"): (1, 1.0, 0.0), ("b", "x"): (1, 2.0, 0.0)}
    assert scaler_of(spark.createDataFrame([], moments.SCHEMA)).count() == 0


def test_targets_of_a_price_of_zero(spark, price_table):
    from tidemark.operators.trends import indicators
    df = price_table(_00001=[10.0] * 40 + [0.0] + [10.0] * 40)
    out = features.training_targets(indicators(df)).where("close = 0").first()
    assert out.short_reversal_label == 0.0 and out.long_reversal_label == 0.0
