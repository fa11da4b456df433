"""Quality of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_metrics(label: str, pred: str) -> dict[str, Column]:
    return {"accuracy": F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0))}


def regression_metrics(label: str, pred: str) -> dict[str, Column]:
    """MSE, MAE and R2 in one pass; the label's variance gives the total sum of squares."""
    miss = F.col(label) - F.col(pred)
    total = F.var_pop(label)
    return {"mse": F.avg(miss * miss), "mae": F.avg(F.abs(miss)),
            "r2": 1 - F.avg(miss * miss) / F.when(total > 0, total)}


def judged(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(name) for name, x in metrics.items()])


def eval_classification(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return judged(df, classification_metrics(label, pred))


def eval_regression(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return judged(df, regression_metrics(label, pred))
