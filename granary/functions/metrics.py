"""Regression and classification metrics as aggregate columns; null over no rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.stats import col


def mse(y, p) -> Column:
    d = col(y) - col(p)
    return F.avg(d * d)


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def r2(y, p) -> Column:
    """1 - residual over total squares; null where the truth is constant."""
    d = col(y) - col(p)
    return 1 - F.sum(d * d) / F.nullif(F.var_pop(col(y)) * F.count(col(y)), F.lit(0.0))


def accuracy(y, p) -> Column:
    return F.avg((col(y) == col(p)).cast("double"))


def precision(y, p, positive) -> Column:
    hits, all_ = F.count_if((col(p) == positive) & (col(y) == positive)), F.count_if(col(p) == positive)
    return F.coalesce(F.try_divide(hits.cast("double"), all_), F.lit(0.0))


def recall(y, p, positive) -> Column:
    hits, all_ = F.count_if((col(p) == positive) & (col(y) == positive)), F.count_if(col(y) == positive)
    return F.coalesce(F.try_divide(hits.cast("double"), all_), F.lit(0.0))


def f1(y, p, positive) -> Column:
    a, b = precision(y, p, positive), recall(y, p, positive)
    return F.coalesce(F.try_divide(2 * a * b, a + b), F.lit(0.0))


def training_accuracy(y, p) -> Column:
    """Percent of predictions within one half of the truth."""
    return F.avg((F.abs(col(p) - col(y)) < 0.5).cast("double")) * 100


#: (name, whether higher is better)
CATALOG = (("MSE", False), ("RMSE", False), ("MAE", False), ("R2", True), ("Accuracy", True), ("Precision", True), ("Recall", True), ("F1", True))
