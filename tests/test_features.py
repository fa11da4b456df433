import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE, lay_out, settle
from tidemark.operators import features, trends
from tidemark.operators.evaluation import eval_classification, eval_regression
from tidemark.params import LearnParams, SplitParams, TrendParams

WALK = (1000 + np.random.default_rng(5).normal(0, 5, 2600).cumsum()).round(2).tolist()


@pytest.mark.parametrize("n", [100, 137, 533, 1000])
def test_three_way_split(price_table, n):
    df = features.time_split_3way(price_table(_00001=WALK[:n]))
    got = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    head = int(n * (1.0 - (1.0 - 0.8 - 0.1)))
    train = int(head * (1.0 - 0.1 / (0.8 + 0.1)))
    want = {"train": train if train >= 100 else 0, "val": head - train if head - train >= 10 else 0,
            "test": n - head if n - head >= 10 else 0}
    assert got == {k: v for k, v in want.items() if v}
    assert n != 533 or got == {"train": 425, "val": 54, "test": 54}


def test_split_is_chronological(price_table):
    df = features.time_split(price_table(_00001=WALK[:103], _00002=WALK[:7]))
    edges = df.groupBy(CODE).agg(F.max(F.when(F.col("split") == "train", F.col("date"))).alias("a"),
                                 F.min(F.when(F.col("split") == "test", F.col("date"))).alias("b"),
                                 F.count_if(F.col("split") == "train").alias("n"))
    assert {r[CODE]: r.n for r in edges.collect()} == {"00001": 82, "00002": 5}
    assert edges.where("a >= b").count() == 0


def test_ratios_are_checked():
    with pytest.raises(ValueError):
        SplitParams(0.8, 0.3, 0.1)
    with pytest.raises(ValueError):
        TrendParams(short_window=25, long_window=5)
    with pytest.raises(ValueError):
        LearnParams(lookback=0)


def test_targets(price_table):
    df = features.training_targets(trends.indicators(price_table(_00001=WALK[:120])))
    rows = df.orderBy("date").collect()
    assert rows[10].short_reversal_label == pytest.approx(WALK[15] / WALK[10] - 1)
    assert rows[117].short_reversal_label == 0.0 and rows[100].long_reversal_label == 0.0
    assert {r.short_trend_label for r in rows} <= {0.0, 1.0, 2.0}
    assert all(0 <= r.confidence_label <= 1 for r in rows)


def test_sequences_stay_in_their_series(price_table):
    df = features.sequences(price_table(_00001=WALK[:30], _00002=WALK[100:119], _00003=WALK[:18]),
                            10, ["close", "volume"])
    rows = {(r[CODE], r.close): r.sequence for r in df.collect()}
    assert len(rows) == 20  # 30 - 10 of the first; the others are shorter than 10 + 10 rows
    seq = rows[("00001", WALK[10])]
    assert [x[0] for x in seq] == WALK[:10] and seq[0][1] == 100.0
    last = features.last_sequences(price_table(_00001=WALK[:30], _00002=WALK[:9]), 10, ["close"])
    assert [(r[CODE], [x[0] for x in r.sequence]) for r in last.collect()] == [("00001", WALK[20:30])]


def test_scaler(price_table):
    df = price_table(_00001=WALK[:50], _00002=[7.0] * 20)
    out = features.scale_features(df, cols=["close", "volume"]).toPandas()
    one = out[out[CODE] == "00001"]["close"]
    assert one.mean() == pytest.approx(0, abs=1e-9) and one.std(ddof=0) == pytest.approx(1)
    assert (out["volume"] == 0).all() and (out[out[CODE] == "00002"]["close"] == 0).all()
    long = features.scaler_params(df, ["close"]).where("stock_code = '00002'").first()
    assert (long.feature, long["mean"], long.scale) == ("close", 7.0, 1.0)


def test_fill_forward(price_table):
    gappy = F.when((F.dayofyear("date") > 40) & (F.dayofyear("date") % 5 == 0), F.col("close"))
    df = price_table(_00001=WALK[:80]).withColumn("x", gappy)
    got = [r.x for r in features.ffill_features(df, ["x"]).orderBy("date").collect()]
    want = pd.Series([r.x for r in df.orderBy("date").collect()], dtype=float).ffill().fillna(0)
    assert got == want.tolist()


def test_fill_forward_over_slabs(price_table):
    """The last known value may lie many slabs back, in a margin, or in the slab itself."""
    df = price_table(_00001=WALK).withColumn(
        "x", F.when(F.col("close").isin(WALK[5], WALK[1090], WALK[2400]), F.col("close")))
    for rows in (1100, 1300, 100000):
        got = settle(features.ffill_features(lay_out(df, rows), ["x"])).orderBy("pos").collect()
        want = pd.Series([r.x for r in df.orderBy("date").collect()], dtype=float).ffill().fillna(0)
        assert [r.x for r in got] == want.tolist()


def test_sequences_over_slabs(price_table):
    df = price_table(_00001=WALK)
    key = lambda out: {(r["date"], str(r["sequence"])) for r in out.collect()}
    plain = key(features.sequences(df, 60, ["close"]))
    assert key(settle(features.sequences(lay_out(df, 1100), 60, ["close"]))) == plain


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, pred double")
    m = eval_regression(df).first()
    assert (m.mse, m.mae) == pytest.approx((1.25 / 3, 0.5))
    assert m.r2 == pytest.approx(1 - 1.25 / np.sum((np.array([1, 2, 4]) - 7 / 3) ** 2))
    assert eval_classification(df).first().accuracy == pytest.approx(1 / 3)
    assert eval_regression(df.withColumn("label", F.lit(1.0))).first().r2 is None
