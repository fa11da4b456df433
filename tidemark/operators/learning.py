"""Training of, and prediction with, the five models on Spark's own learners.

Two classifiers call the trends, two regressors the forward returns and one rates the
confidence. All read the flattened sequence of a code's last standardised feature rows.
The feature rows are written once, in buckets by code, and read back, so that the passes of an
iterative fit, and lost executors, do not repeat the indicators, and nothing by code shuffles
them again; they are standardised where they are read. Models are fitted on the sequences of all
training rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor,
                                   GeneralizedLinearRegressionModel)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import CODE, keys_of, parts_of, settle
from ..params import KINDS, MODEL_FEATURES, LearnParams, SplitParams, TrendParams
from ..sources.tables import stored, stored_by_code
from .evaluation import classification_metrics, regression_metrics
from .features import (feature_array, ffill_features, fit_scaler, last_sequences, long_enough,
                       rows_before, scale_features, sequences, time_split, training_targets)
from .fitting import Packs, Perceptron, logistic, mean_log_loss, packed
from .forecasts import (Answer, adjust_reversal_confidence, answer_columns, basic_reversal,
                        basic_trend, clamp_reversal_price, end_rows, profile)
from .indicators import DEFAULT
from .selection import min_history
from .trends import indicators, symbol

MODELS = {
    "short_trend_classifier": ("short_trend_label", MultilayerPerceptronClassificationModel),
    "long_trend_classifier": ("long_trend_label", MultilayerPerceptronClassificationModel),
    "short_reversal_regressor": ("short_reversal_label", GBTRegressionModel),
    "long_reversal_regressor": ("long_reversal_label", GBTRegressionModel),
    "confidence_estimator": ("confidence_label", GeneralizedLinearRegressionModel),
}
LABELS = [label for label, _ in MODELS.values()]
# Rows up to which the rows that the fitted sequences consist of are sent to every task.
SMALL_ASKED = 1 << 20
FEATURES = list(MODEL_FEATURES)


@dataclass(frozen=True)
class Learning:
    """The standardised feature rows with their labels, the scaler that made them, and the
    sequences of the training rows, which models are fitted on."""
    table: DataFrame
    scaler: DataFrame
    params: LearnParams
    trends: TrendParams
    fitted: DataFrame
    packs: Packs
    splits: SplitParams = SplitParams()
    #: Losses on the validating rows of models that were trained step by step, the deviance of others.
    losses: dict[str, list[float]] = field(default_factory=dict)

    def sequences(self, split: str) -> DataFrame:
        """One sequence for every row of a part, made where they are read and never stored. Only
        the part's own rows and the ``lookback`` ones before them are looked at."""
        pos, cut = F.col("pos"), rows_before(self.splits.train_ratio)
        seen = pos < cut if split == "train" else pos >= cut - self.params.lookback
        made = sequences(self.table.where(seen), self.params.lookback, FEATURES)
        return made.where(F.col("split") == split).select(
            CODE, "date", "split", "validates", flat().alias("features"), *LABELS)


def flat(c: str = "sequence"):
    return array_to_vector(F.flatten(c))


def able_rows(table: DataFrame, l: LearnParams) -> DataFrame:
    """The training rows with a whole sequence before them."""
    return long_enough(table, l.lookback + 10).where(
        (F.col("split") == "train") & (F.col("pos") >= l.lookback))


def taken(table: DataFrame, l: LearnParams):
    """Whether a training row is fitted on: all are, unless ``fit_rows`` are asked for."""
    if l.fit_rows is None:
        return F.lit(True)
    share = min(1.0, l.fit_rows / max(1, able_rows(table, l).count()))
    return F.pmod(F.xxhash64(CODE, "pos", F.lit(l.seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def packed_rows(table: DataFrame, l: LearnParams) -> DataFrame:
    """The training rows in packs, for the fits that read all of them many times."""
    train = ffill_features(long_enough(table, l.lookback + 10).where("split = 'train'"), FEATURES)
    train = train.withColumn("taken", taken(table, l)).sortWithinPartitions(CODE, "pos")
    return packed(train, l.lookback, FEATURES, LABELS)


def chosen_sequences(table: DataFrame, l: LearnParams) -> DataFrame:
    """The sequences of all training rows. Where ``fit_rows`` are asked for, of about so many, those
    with the smallest hashes: each asks for its rows by position, so that no other row's sequence is
    built."""
    if l.fit_rows is None:
        made = sequences(table.where("split = 'train'"), l.lookback, FEATURES)
        return made.select(CODE, "date", "split", "validates", flat().alias("features"), *LABELS)
    chosen = able_rows(table, l).where(taken(table, l)).select(CODE, F.col("pos").alias("of"), "date", "split", "validates", *LABELS)
    asked = chosen.withColumn("pos", F.explode(F.sequence(F.col("of") - l.lookback, F.col("of") - 1)))
    # bounded by the parameters, not by the table, which then stays where it is
    asked = F.broadcast(asked) if l.fit_rows * l.lookback <= SMALL_ASKED else asked
    row = F.struct("pos", feature_array(FEATURES).alias("x"))
    filled = ffill_features(table, FEATURES).select(CODE, "pos", row.alias("row"))
    rest = ["date", "split", "validates", *LABELS]
    made = asked.join(filled, [CODE, "pos"]).groupBy(CODE, "of").agg(
        F.sort_array(F.collect_list("row")).alias("rows"), *[F.first(c).alias(c) for c in rest])
    return made.select(CODE, "date", "split", "validates",
                       flat(F.transform("rows", lambda r: r["x"])).alias("features"), *LABELS)


def prepare_learning(prices: DataFrame, p: TrendParams = DEFAULT,
                     s: SplitParams = SplitParams(), l: LearnParams = LearnParams(),
                     rows: int | None = None) -> Learning:
    """Indicators over whole series, a chronological cut, scaling by the training part
    only. The last fifth of a training part validates. Of a table of about ``rows`` rows a task
    holds no more of when it grows; its parts are the buckets of the feature rows."""
    long, parts = min_history(prices, p.min_data_points), None
    if rows is not None:
        parts = parts_of(rows, prices.sparkSession.sparkContext.defaultParallelism)
        long = long.repartition(parts, CODE)
    made = training_targets(indicators(long, p), p)
    made = settle(time_split(made, s.train_ratio))
    train = rows_before(s.train_ratio)
    made = made.withColumn("validates", (F.col("split") == "train")
                           & (F.col("pos") >= rows_before(0.8, train)))
    made = made.fillna(0.0, FEATURES)
    made = stored_by_code(made.select(CODE, "date", "pos", "n", "split", "validates", *FEATURES, *LABELS),
                          "learning", parts)
    scaler = stored(fit_scaler(made.where("split = 'train'"), FEATURES), "scaler")
    table = scale_features(made, scaler, FEATURES)
    # a step of a fit adds up as many gradients as there are parts: few, as the fitted rows are bounded
    packs = Packs(stored(packed_rows(table, l), "packs"), l.lookback, len(FEATURES), tuple(LABELS))
    return Learning(table, scaler, l, p, chosen_sequences(table, l), packs, s)


def log_loss(model: Model, rows: DataFrame | Packs) -> float | None:
    """The mean of what each row's true class was thought unlikely by; none without rows."""
    if isinstance(rows, Packs):
        return mean_log_loss(model, rows)
    told = model.transform(rows).select(vector_to_array(model.getProbabilityCol()).alias("p"), F.col(model.getLabelCol()).cast("int").alias("y"))
    return told.agg(F.avg(-F.log(F.greatest(F.get("p", F.col("y")), F.lit(1e-15))))).head()[0]


def fit_with_patience(learner, steps: int, each: int, patience: int, train: DataFrame | Packs,
                      held: DataFrame | Packs) -> tuple[Model, list[float | None]]:
    """Trains `each` iterations at a time, every time from the weights reached so far, and judges them
    on the held rows. It ends after `steps` iterations, after `patience` judgements without a better
    one, or when the weights no longer change; the best weights are returned with all judgements.
    Without held rows it trains to the end."""
    best, losses, least, weights = None, [], None, None
    while len(losses) * each < steps:
        some = learner.copy().setMaxIter(min(each, steps - len(losses) * each))
        model = (some.setInitialWeights(weights) if weights is not None else some).fit(train)
        loss = log_loss(model, held)
        settled = weights is not None and model.weights == weights
        weights = model.weights
        losses.append(loss)
        if best is None or loss is None or loss < least:
            best, least, waited = model, loss, 0
        else:
            waited += 1
        if settled or waited >= patience:
            break
    return best, losses


def train_trend_classifier(data: Learning, kind: str) -> tuple[Model, list[float]]:
    """The classifier at its best step, and its losses on the validating rows step by step."""
    l = data.params
    layers = [l.lookback * len(FEATURES), *l.hidden_layers, 3]
    learner = Perceptron(f"{kind}_trend_label", tuple(layers), l.seed)
    train, held = (data.packs.where(v) for v in (False, True))
    return fit_with_patience(learner, l.max_iter, l.step_iter, l.patience, train, held)


def train_reversal_regressor(data: Learning, kind: str) -> Model:
    """Boosting stops when the validating rows no longer improve."""
    l = data.params
    learner = GBTRegressor(
        labelCol=f"{kind}_reversal_label", maxIter=l.tree_iter, maxDepth=l.tree_depth,
        validationIndicatorCol="validates", seed=l.seed)
    return learner.fit(data.fitted)


def train_confidence(data: Learning) -> Model:
    """A logistic model; its deviance is kept with the losses."""
    model, deviance = logistic(data.packs, "confidence_label", 0.01, max(1, data.params.max_iter // 2))
    data.losses["confidence_estimator"] = [deviance]
    return model


def train_models(data: Learning) -> dict[str, Model]:
    models = {}
    for k in KINDS:
        models[f"{k}_trend_classifier"], data.losses[f"{k}_trend_classifier"] = train_trend_classifier(data, k)
    models.update({f"{k}_reversal_regressor": train_reversal_regressor(data, k) for k in KINDS})
    models["confidence_estimator"] = train_confidence(data)
    return models


def evaluate_models(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """One row of metrics per model, from one pass over the rows."""
    told = apply_models(models, rows)
    parts = []
    for name in models:
        label = MODELS[name][0]
        classifies = name.endswith("classifier")
        judge = classification_metrics if classifies else regression_metrics
        of = judge(label, f"{name}_class" if classifies else name)
        parts.append(F.struct(
            F.lit(name).alias("model"), F.lit("classification" if classifies else "regression").alias("type"),
            F.count(F.lit(1)).alias("rows"),
            *[of.get(m, F.lit(None).cast("double")).alias(m) for m in ("accuracy", "mse", "mae", "r2")]))
    return told.agg(F.array(*parts).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def tree_losses(model: GBTRegressionModel, rows: DataFrame, label: str) -> list[float]:
    """The mean squared error after each tree, from one pass over the rows; none without rows."""
    told, so_far, means = rows, F.lit(0.0), []
    for i, (tree, share) in enumerate(zip(model.trees, model.treeWeights)):
        told = tree.copy().setPredictionCol(f"_tree_{i}").transform(told)
        so_far = so_far + F.col(f"_tree_{i}") * F.lit(share)
        means.append(F.avg((F.col(label) - so_far) * (F.col(label) - so_far)).alias(f"_{i}"))
    return [x for x in told.agg(*means).head() if x is not None]


def histories(models: dict[str, Model], data: Learning) -> DataFrame:
    """Each model's loss on the validating rows step by step while it was trained; the deviance of
    one that is fitted at once."""
    rows, fitted = [], data.fitted
    for name, m in models.items():
        losses: list[float] = []
        if name in data.losses:
            losses = data.losses[name]
        elif isinstance(m, GBTRegressionModel):
            losses = tree_losses(m, fitted.where("validates"), MODELS[name][0])
        rows += [(name, i, None if x is None else float(x)) for i, x in enumerate(losses)]
    return fitted.sparkSession.createDataFrame(rows, "model string, step int, loss double")


def model_summary(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """Size of each fitted model."""
    rows = []
    for name, m in models.items():
        if isinstance(m, MultilayerPerceptronClassificationModel):
            layers = list(m.getLayers())
            size = sum((a + 1) * b for a, b in zip(layers, layers[1:]))
            rows.append((name, size, len(layers), layers[0], layers[-1]))
        elif isinstance(m, GBTRegressionModel):
            rows.append((name, m.totalNumNodes, m.getNumTrees, m.numFeatures, 1))
        else:
            rows.append((name, m.numFeatures + 1, 1, m.numFeatures, 1))
    return spark.createDataFrame(
        rows, "model string, parameters long, layers int, inputs int, outputs int")


@dataclass(frozen=True)
class Saved:
    """All that a prediction needs."""
    models: dict[str, Model]
    scaler: DataFrame
    params: LearnParams
    trends: TrendParams


def save_models(models: dict[str, Model], metrics: DataFrame, data: Learning, root: str,
                run_ts: str) -> None:
    """Every model in a folder of its own beside its metrics, the history of its training, the
    scaler and the parameters, and a table of contents, which is written last."""
    spark = metrics.sparkSession
    for name, model in models.items():
        model.write().save(f"{root}/{name}")
    metrics.write.json(f"{root}/metrics")
    histories(models, data).write.json(f"{root}/history")
    data.scaler.write.parquet(f"{root}/scaler")
    told = json.dumps({"learning": asdict(data.params), "trends": asdict(data.trends)})
    spark.createDataFrame([(told,)], "parameters string").write.text(f"{root}/parameters")
    spark.createDataFrame([(name, run_ts) for name in models],
                          "model string, training_date string").write.json(f"{root}/contents")


def load_contents(spark: SparkSession, root: str) -> list[str]:
    """The models listed in the table of contents (at most the five known names)."""
    listed = spark.read.schema("model string").json(f"{root}/contents")
    return [r.model for r in listed.where(F.col("model").isin(list(MODELS))).collect()]


def load_models(spark: SparkSession, root: str) -> dict[str, Model]:
    return {name: MODELS[name][1].load(f"{root}/{name}") for name in load_contents(spark, root)}


def load_saved(spark: SparkSession, root: str) -> Saved:
    told = json.loads(spark.read.text(f"{root}/parameters").head()[0])
    learned = {**told["learning"], "hidden_layers": tuple(told["learning"]["hidden_layers"])}
    return Saved(load_models(spark, root), spark.read.parquet(f"{root}/scaler"),
                 LearnParams(**learned), TrendParams(**told["trends"]))


def prediction_input(prices: DataFrame, scaler: DataFrame, l: LearnParams,
                     p: TrendParams = DEFAULT) -> DataFrame:
    """The latest standardised sequence of each code (and member of an ensemble) as a vector."""
    made = indicators(prices, p, l.lookback).fillna(0.0, FEATURES)
    scaled = scale_features(made, scaler, FEATURES)
    return last_sequences(scaled, l.lookback, FEATURES).select(*keys_of(prices), flat().alias("features"))


def apply_models(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """The raw answers of all models beside each other, one row per code."""
    df = rows
    for name, m in models.items():
        if name.endswith("classifier"):
            m = m.copy().setPredictionCol(f"{name}_class").setProbabilityCol(f"{name}_p")
            m = m.setRawPredictionCol(f"{name}_raw")
        else:
            m = m.copy().setPredictionCol(name)
        df = m.transform(df)
    chances = [n for n in models if n.endswith("classifier")]
    return df.withColumns({f"{n}_p": vector_to_array(f"{n}_p") for n in chances})


def predict_trend(answers: DataFrame, kind: str) -> DataFrame:
    name = f"{kind}_trend_classifier"
    p, numeric = F.col(f"{name}_p"), (F.col(f"{name}_class") - 1).cast("int")
    return answers.select(
        CODE, symbol(numeric).alias("trend"), numeric.alias("trend_numeric"),
        F.array_max(p).alias("confidence"),
        F.struct(p[0].alias("down"), p[1].alias("sideways"), p[2].alias("up"))
        .alias("probabilities"), F.lit("model").alias("method"))


def base_confidence(answers: DataFrame):
    has = "confidence_estimator" in answers.columns
    return F.coalesce("confidence_estimator", F.lit(0.5)) if has else F.lit(0.5)


def predict_reversal(answers: DataFrame, stats: DataFrame, kind: str) -> DataFrame:
    """Reversal price from the predicted change; ``stats`` is the codes' profile."""
    change = F.col(f"{kind}_reversal_regressor")
    df = answers.join(stats, CODE)
    return df.select(
        CODE, clamp_reversal_price(F.col("current_price"), change).alias("price"),
        "current_price", (change * 100).alias("predicted_change_pct"),
        adjust_reversal_confidence(base_confidence(answers), change, F.col("recent_spread"))
        .alias("confidence"), F.lit("model").alias("method"))


def model_answers(saved: Saved) -> Answer:
    """The answers of models as a method for ``predict_stock``: what a code is too short for, or
    a missing model does not say, is answered without models. The copies of an ensemble stay with
    the series they are copies of, are scaled as those are, and of their profile only what the last
    rows tell is answered."""
    def answer(prices: DataFrame, p: TrendParams) -> DataFrame:
        keys = keys_of(prices)
        told = apply_models(saved.models, prediction_input(prices, saved.scaler, saved.params, p))
        ends = prices if len(keys) == 1 else prices.where(F.col("n") - F.col("pos") <= end_rows(p))
        df = profile(ends, p).join(told.drop("features"), keys, "left")
        has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
        base, parts = base_confidence(df), {}
        for k in KINDS:
            plain = {**basic_trend(k, p), **basic_reversal(k, p)}
            cls, change = has(f"{k}_trend_classifier_class"), has(f"{k}_reversal_regressor")
            sure = (F.array_max(f"{k}_trend_classifier_p") if f"{k}_trend_classifier_p" in df.columns
                    else F.lit(None).cast("double"))
            either = lambda known, x, name: F.when(known.isNotNull(), x).otherwise(plain[name])
            parts[k] = {
                "trend": either(cls, symbol((cls - 1).cast("int")), "trend"),
                "trend_confidence": either(cls, sure, "trend_confidence"),
                "trend_method": either(cls, F.lit("model"), "trend_method"),
                "reversal_price": either(change, clamp_reversal_price(F.col("current_price"), change), "reversal_price"),
                "reversal_confidence": either(change, adjust_reversal_confidence(
                    base, change, F.col("recent_spread")), "reversal_confidence"),
                "reversal_method": either(change, F.lit("model"), "reversal_method"),
            }
        return df.select(*keys[1:], *answer_columns(parts, p, base))
    # it knows members, and looks at so many last rows of them (at all rows of the closes)
    answer.rows = max(saved.params.lookback, 1)
    return answer
