import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tidemark.operators import fitting, learning
from tidemark.params import LearnParams, TrendParams

P = TrendParams(trend_threshold=0.2)
L = LearnParams(lookback=4, hidden_layers=(6,), max_iter=20, step_iter=10, tree_iter=3, tree_depth=2)


@pytest.fixture(scope="module")
def data(price_table):
    rng = np.random.default_rng(7)
    made = {f"_{i:05d}": (100 + rng.normal(0, 1, 130 + 10 * i).cumsum() + 50).round(2).tolist() for i in range(5)}
    prices = price_table(**made).withColumn("volume", 100.0 + F.pmod(F.hash("stock_code", "date"), F.lit(50)))
    return learning.prepare_learning(prices, P, l=L)


def rows_of(data, held=None):
    df = data.fitted if held is None else data.fitted.where(F.col("validates") == held)
    return df.select(vector_to_array("features").alias("x"), "confidence_label", "short_trend_label").collect()


@pytest.mark.parametrize("held", [None, True, False])
def test_packs_hold_every_sequence_once(data, held, monkeypatch):
    """Also where a series goes on in the next pack, and where tasks add up the sums."""
    small = fitting.Packs(data.packs.table, L.lookback, 17, data.packs.labels, held)
    want = rows_of(data, held)
    told = lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
    x = np.array([r.x for r in want])
    sums = np.concatenate([[len(want), sum(r.confidence_label for r in want)], x.sum(axis=0), (x * x).sum(axis=0)])
    assert small.summed("confidence_label", told) == pytest.approx(sums)
    monkeypatch.setattr(fitting, "PACK_ROWS", 16)
    monkeypatch.setattr(fitting, "FEW_SUMS", 0)
    cut = fitting.Packs(learning.packed_rows(data.table, L), L.lookback, 17, data.packs.labels, held)
    assert cut.table.count() > 4 * 5 and cut.summed("confidence_label", told) == pytest.approx(sums)


def test_what_is_stored_does_not_grow_with_the_lookback(data):
    """A row lies in the packs once, and not in the sequences of all rows after it."""
    held = data.packs.table.agg(F.sum(F.octet_length("x"))).head()[0]
    train = data.table.where("split = 'train'").count()
    assert train * 17 * 8 <= held <= (train + 60) * 17 * 8
    assert not [f for f in data.fitted.inputFiles() if "/sequences-" in f]


def test_chosen_rows_alone_are_packed(price_table, data):
    few = LearnParams(lookback=4, fit_rows=60)
    some = fitting.Packs(learning.packed_rows(data.table, few), 4, 17, data.packs.labels)
    rows = some.summed("confidence_label", lambda x, y: np.array([len(y)]))[0]
    assert rows == learning.chosen_sequences(data.table, few).count() < 100


def test_no_rows(data):
    none = fitting.Packs(data.packs.table.limit(0), 4, 17, data.packs.labels)
    assert none.summed("confidence_label", lambda x, y: np.ones(1)) is None
    with pytest.raises(ValueError, match="no rows"):
        fitting.Perceptron("short_trend_label", (68, 3), 1).fit(none)


def test_confidence_is_fitted_as_sparks_own_learner_fits_it(data):
    model = learning.train_confidence(data)
    own = GeneralizedLinearRegression(labelCol="confidence_label", family="binomial", link="logit", regParam=0.01, maxIter=10).fit(data.fitted)
    assert model.intercept == pytest.approx(own.intercept, rel=1e-6, abs=1e-6)
    assert list(model.coefficients) == pytest.approx(list(own.coefficients), rel=1e-5, abs=1e-6)
    assert data.losses["confidence_estimator"] == [pytest.approx(own.summary.deviance, rel=1e-6)]


def test_the_slope_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    layers, x, y = [5, 4, 3, 3], rng.normal(size=(20, 5)), rng.integers(0, 3, 20).astype(float)
    w = fitting.first_weights(layers, 1)
    told, step = fitting.loss_and_gradient(w, layers, x, y), 1e-6
    for i in range(len(w)):
        d = np.eye(len(w))[i] * step
        up, down = (fitting.loss_and_gradient(w + s * d, layers, x, y)[1] for s in (1, -1))
        assert told[2 + i] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_the_least_is_found():
    scale = np.array([1.0, 10.0, 100.0])
    f = lambda x: (float((scale * (x - 3) ** 2).sum()), 2 * scale * (x - 3))
    assert fitting.minimised(f, np.zeros(3), 50) == pytest.approx([3, 3, 3], abs=1e-3)
    assert f(fitting.minimised(f, np.zeros(3), 1))[0] < f(np.zeros(3))[0]


def test_a_classifier_answers_as_its_layers_say(data):
    model, losses = learning.train_trend_classifier(data, "short")
    told = model.transform(data.fitted).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    own = fitting.forward(model.weights.toArray(), list(model.getLayers()), np.array([r.x for r in told]))[-1]
    assert np.array([r.p for r in told]) == pytest.approx(own, abs=1e-9)
    held = data.fitted.where("validates")
    assert learning.log_loss(model, held) == pytest.approx(min(losses)) == pytest.approx(learning.log_loss(model, data.packs.where(True)))


def test_losses_of_trees(data):
    model = learning.train_reversal_regressor(data, "short")
    held = data.fitted.where("validates")
    own = model.evaluateEachIteration(held.withColumn("label", F.col("short_reversal_label")).select("features", F.col("label").alias(model.getLabelCol())), "squared")
    assert learning.tree_losses(model, held, "short_reversal_label") == pytest.approx(list(own))
    assert learning.tree_losses(model, held.limit(0), "short_reversal_label") == []
