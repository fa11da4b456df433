"""Saved models as tables: SQL over them answers as the models do; and training with patience."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.functions.series import CODE
from tidemark.operators import learning, model_tables
from tidemark.params import LearnParams, TrendParams
from tidemark.plans.pipeline import update_models
from tidemark.session import workspace

SMALL = LearnParams(lookback=3, hidden_layers=(8, 5), max_iter=12, step_iter=4, tree_iter=4, tree_depth=3)
P = TrendParams(trend_threshold=0.2)

# A forward pass over two hidden layers, a walk down the trees and a logistic sum.
FORWARD = """
with recursive
z1 as (select code, model, output, sum(x * weight) as z from x join w using (input) where layer = 1 group by all),
h1 as (select code, model, output as input, 1 / (1 + exp(-z)) as x from z1
       union all select distinct code, model, -1, 1.0 from z1),
z2 as (select code, model, output, sum(x * weight) as z from h1 join w using (model, input) where layer = 2 group by all),
h2 as (select code, model, output as input, 1 / (1 + exp(-z)) as x from z2
       union all select distinct code, model, -1, 1.0 from z2),
z3 as (select code, model, output, sum(x * weight) as z from h2 join w using (model, input) where layer = 3 group by all),
chances as (select code, model || '/' || output as answer, exp(z) / sum(exp(z)) over (partition by code, model) as told from z3),
walk as (
  select code, t.* from (select distinct code from x) cross join (select * from t where node = 0) t
  union all
  select a.code, t.* from walk a join x on x.code = a.code and x.input = a.feature
    join t on t.model = a.model and t.tree = a.tree and t.node = case when x.x <= a.threshold then a."left" else a."right" end),
changes as (select code, model as answer, sum(share * value) as told from walk where feature is null group by all),
sure as (select code, model as answer, 1 / (1 + exp(-sum(x * weight))) as told from x join c using (input) group by all)
select * from chances union all select * from changes union all select * from sure"""


@pytest.fixture(scope="module")
def run(spark, price_table):
    rng = np.random.default_rng(4)
    prices = price_table(**{f"_{i:05d}": (150 + rng.normal(0, 1, 170).cumsum()).round(2).tolist() for i in range(5)})
    root = workspace(spark, "models")
    models, data, _ = update_models(prices, root, "2025-01-01", P, l=SMALL)
    return root, models, data, learning.prediction_input(prices, data.scaler, SMALL, P)


def test_sql_over_the_tables(spark, run):
    root, models, _, inputs = run
    con = duckdb.connect()
    frames = {"w": model_tables.layer_weights(spark, root), "t": model_tables.tree_nodes(spark, root),
              "c": model_tables.coefficients(spark, root), "x": model_tables.inputs_long(inputs).withColumnRenamed(CODE, "code")}
    for name, df in frames.items():
        con.register(name, df.toPandas())
    told = {(code, answer): value for code, answer, value in con.execute(FORWARD).fetchall()}
    count = 0
    for r in learning.apply_models(models, inputs).collect():
        for name in models:
            own = {f"{name}/{i}": p for i, p in enumerate(r[f"{name}_p"])} if name.endswith("classifier") else {name: r[name]}
            for answer, value in own.items():
                assert told[r[CODE], answer] == pytest.approx(value, rel=1e-9, abs=1e-12)
                count += 1
    assert count == len(told) == 5 * (3 + 3 + 1 + 1 + 1)


def test_scores_of_the_tables(spark, run):
    root, models, _, inputs = run
    out = {r.model: (r.codes, r.differing) for r in model_tables.table_differences(models, spark, root, inputs).collect()}
    assert out == {name: (5, 0) for name in learning.MODELS}
    # other inputs, other answers: the comparison sees them
    moved = inputs.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: x + 1)))
    both = model_tables.score_tables(spark, root, inputs).unionByName(model_tables.score_tables(spark, root, moved))
    assert both.select("confidence_estimator").distinct().count() > 5


def test_history_holds_validation_losses(spark, run):
    root, models, data, _ = run
    held = data.fitted.where("validates")
    for kind in ("short", "long"):
        name = f"{kind}_trend_classifier"
        told = [r.loss for r in spark.read.json(f"{root}/history").where(F.col("model") == name).orderBy("step").collect()]
        assert told == pytest.approx(data.losses[name]) and 1 <= len(told) <= 3
        # the saved model is the best step, not the last
        assert learning.log_loss(learning.load_models(spark, root)[name], held) == pytest.approx(min(told))


def test_patience(spark):
    """Held rows with turned labels get worse the more is learnt: training ends early, at its best."""
    rng = np.random.default_rng(1)
    rows = [(int(x > 0), [float(x), float(rng.normal())]) for x in rng.normal(size=200)]
    df = spark.createDataFrame(rows, "label int, x array<double>").select("label", array_to_vector("x").alias("features")).cache()
    turned = df.withColumn("label", 1 - F.col("label"))
    learner = MultilayerPerceptronClassifier(layers=[2, 4, 2], seed=3)
    best, losses = learning.fit_with_patience(learner, 60, 3, 2, df, turned)
    assert len(losses) == losses.index(min(losses)) + 3 < 20
    assert learning.log_loss(best, turned) == pytest.approx(min(losses))
    _, whole = learning.fit_with_patience(learner, 10, 4, 2, df, df.limit(0))
    assert whole == [None] * 3


def test_scores_read_a_row_an_input_once(spark, run):
    """A layer's join has a row for each input of a code, whatever the outputs; no layer is computed twice, and
    what the trees ask of a code is looked up in its vector, without a shuffle of its inputs."""
    root, _, _, inputs = run
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    layers = plan(model_tables.score_layers(model_tables.layer_weights(spark, root), inputs))
    assert "SortMergeJoin" not in layers
    steps = layers.count("Generate posexplode(array(") + layers.count("Generate posexplode(concat(")
    trees = plan(model_tables.score_trees(model_tables.tree_nodes(spark, root), inputs, 2))
    assert steps <= 4 and "Generate" not in trees and "SortMergeJoin" not in trees and "Union" not in trees.split("BroadcastExchange")[0]
