import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import learning
from tidemark.params import LearnParams, TrendParams
from tidemark.plans.pipeline import make_predictions, run_full_pipeline
from tidemark.session import recommended_conf, workspace

RNG = np.random.default_rng(3)
SMALL = LearnParams(lookback=3, hidden_layers=(8,), max_iter=8, tree_iter=3, tree_depth=2)
P = TrendParams(trend_threshold=0.2)


@pytest.fixture(scope="module")
def run(spark, price_table):
    made = {f"_{i:05d}": (100 + RNG.normal(0, 1, 160).cumsum() + 50).round(2).tolist() for i in range(6)}
    made["_00009"] = made["_00001"][:40]
    prices = price_table(**made)
    codes = prices.select(CODE).distinct()
    root = workspace(spark, "models")
    return prices, codes, root, run_full_pipeline(prices, codes, root, "2025-01-01", P, l=SMALL)


def test_pipeline(run):
    prices, codes, _, done = run
    assert set(done.models) == set(learning.MODELS)
    metrics = {r.model: r for r in done.metrics.collect()}
    assert all(0 <= metrics[m].accuracy <= 1 for m in metrics if m.endswith("classifier"))
    assert all(metrics[m].mse >= 0 for m in metrics if m.endswith("regressor"))
    out = done.predictions.collect()
    assert [r[CODE] for r in out if r.error] == ["00009"] and len(out) == 7  # too short a history
    out = [r for r in out if not r.error]
    assert all(r.short_trend in "+-0" and 0 <= r.long_confidence <= 100 for r in out)
    assert all(0.5 <= r.long_reversal_price / r.current_price <= 2 for r in out)
    assert all(r.prediction_methods.long_trend_method == "model" and r.ensemble_trends.short_trend in "+-0" for r in out)
    assert make_predictions(prices, codes, P).where("error is not null").count() == 1


def test_saved_models_predict_the_same(spark, run):
    prices, codes, root, done = run
    again = make_predictions(prices, codes, models=root)
    key = lambda df: sorted((r[CODE], r.error, r.short_trend, r.long_reversal_price, str(r.ensemble_trends)) for r in df.collect())
    assert key(again) == key(done.predictions)
    saved = learning.load_saved(spark, root)
    assert (saved.params, saved.trends) == (SMALL, P)
    assert learning.model_summary(spark, saved.models).count() == 5
    told = {r.model for r in spark.read.json(f"{root}/history").collect()}
    assert told == set(learning.MODELS)


def test_training_part_scales_and_validates(run):
    prices = run[0]
    data = learning.prepare_learning(prices, P, l=SMALL)
    count = lambda df: {(r.split, r.validates): r["count"] for r in df.where("stock_code = '00001'")
                        .groupBy("split", "validates").count().collect()}
    assert count(data.fitted) == {("train", False): 102 - 3, ("train", True): 26}
    assert count(data.sequences("test")) == {("test", False): 32}
    few = learning.prepare_learning(prices, P, l=LearnParams(lookback=3, fit_rows=60)).fitted
    assert 30 < few.count() < 100
    whole = {(r[CODE], r.date): list(r.features) for r in data.sequences("train").collect()}
    assert all(list(r.features) == pytest.approx(whole[r[CODE], r.date]) for r in few.collect())


def test_model_answers(run):
    prices, _, _, done = run
    data = learning.prepare_learning(prices, P, l=SMALL)
    answers = learning.apply_models(done.models, learning.prediction_input(prices, data.scaler, SMALL, P))
    for r in learning.predict_trend(answers, "short").collect():
        chances = [r.probabilities.down, r.probabilities.sideways, r.probabilities.up]
        assert sum(chances) == pytest.approx(1) and r.confidence == max(chances)
        assert r.trend_numeric == int(np.argmax(chances)) - 1


def test_conf_grows_with_the_input():
    for size in (10 ** 9, 10 ** 12, 100 * 10 ** 12):
        conf = recommended_conf(size, 4000)
        partitions, each = int(conf["spark.sql.shuffle.partitions"]), int(conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"])
        assert partitions * each >= size and 4000 <= partitions <= 50_000
    assert recommended_conf(1, 16)["spark.sql.shuffle.partitions"] == "16"


def test_training_shuffles_the_feature_rows_once(spark, run, tmp_path):
    """They lie in buckets by code: neither scaling nor the sequences of the judged rows move them, and
    those are made of the rows they see alone."""
    data = learning.prepare_learning(run[0], P, l=SMALL)
    judged = data.sequences("test")
    plan = judged._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("Exchange hashpartitioning")[1:] if "learning_" in x.split("Exchange")[0]]
    assert "Bucketed: true" in plan and not moved and "floor" in plan.split("PushedFilters")[0].lower()
    assert data.fitted.rdd.getNumPartitions() <= 4


def test_members_stay_with_their_series(run):
    """The votes of copies told apart by a member are those of copies that are series of their own."""
    from tidemark.operators.ensembles import member_predictions
    prices, codes, root, done = run
    saved = learning.load_saved(prices.sparkSession, root)
    answer = learning.model_answers(saved)
    of = prices.sparkSession.createDataFrame([(f"00001#{i}", "00001") for i in range(5)], f"{CODE} string, of string")
    scaler = of.join(saved.scaler.withColumnRenamed(CODE, "of"), "of").drop("of")
    alone = learning.model_answers(learning.Saved(saved.models, scaler, saved.params, saved.trends))
    one = prices.where("stock_code = '00001'")
    cols = ["short_trend", "long_reversal_price", "long_reversal_confidence"]
    key = lambda df: sorted((r.member, r[1], round(r[2], 9), round(r[3], 9)) for r in df.select("member", *cols).collect())
    near, far = (key(member_predictions(one, P, m)) for m in (answer, lambda df, p: alone(df, p)))
    assert len(near) == 5 and near == far


def test_models_are_fitted_on_all_training_rows(spark, price_table):
    """More rows than any bound that was once set: every training row with a whole sequence is fitted on."""
    made = {f"_{i:05d}": (100 + RNG.normal(0, 1, 200).cumsum() + 50).round(2).tolist() for i in range(16)}
    l = LearnParams(lookback=3)
    data = learning.prepare_learning(price_table(**made), P, l=l)
    assert l.fit_rows is None and data.fitted.count() == 16 * (160 - 3) > 2000
    key = lambda df: sorted((r[CODE], r.date, r.validates) for r in df.collect())
    assert key(data.fitted) == key(data.sequences("train"))
