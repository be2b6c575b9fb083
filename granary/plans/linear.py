"""Linear regression by batch gradient descent, from one aggregate.

The gradient of half the mean squared error is linear in the data's moments, so the descent runs on a p x p matrix on
the driver, however many iterations and rows: one Spark job a fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyData, NotFitted, NumericalInstability
from ..operators.stats import Moments, col, moments


def _system(m: Moments) -> tuple[np.ndarray, np.ndarray, float]:
    """Means of products over [features, 1] and target: (G, h, q) with gradient G w - h."""
    second = m.products / m.n + np.outer(m.means, m.means)
    p = len(m.columns) - 1
    g = np.empty((p + 1, p + 1))
    g[:p, :p] = second[:p, :p]
    g[:p, p] = g[p, :p] = m.means[:p]
    g[p, p] = 1.0
    return g, np.append(second[:p, p], m.means[p]), float(second[p, p])


@dataclass
class LinearRegression:
    learning_rate: float = 0.01
    features: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    history: list[float] = field(default_factory=list)

    def initialize(self, features: list[str], scale: float = 0.0, seed: int = 0) -> LinearRegression:
        self.features = list(features)
        self.weights = np.random.default_rng(seed).uniform(-scale / 2, scale / 2, len(features)) if scale else np.zeros(len(features))
        self.bias, self.history = 0.0, []
        return self

    def fit(self, df: DataFrame, features: list[str], target: str, iterations: int = 1000, tolerance: float | None = None, strict: bool = False) -> LinearRegression:
        """Descend from where the model is (zeros at first); costs are taken before each step.

        With a tolerance it stops at the first cost below it.  strict: divergence raises instead of going on.
        """
        if self.weights is None:
            self.initialize(features)
        if len(features) != len(self.weights):
            raise DimensionMismatch(f"Feature dimension mismatch: expected {len(self.weights)}, got {len(features)}")
        m = moments(df, [*features, target])
        if not m.n:
            raise EmptyData("Cannot fit on empty data")
        g, h, q = _system(m)
        theta = np.append(self.weights, self.bias)
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(iterations):
                cost = max(float(theta @ g @ theta - 2 * theta @ h + q) / 2, 0.0)
                if strict and not np.isfinite(cost):
                    raise NumericalInstability("The descent diverged; scale the features or lower the learning rate")
                self.history.append(cost)
                if tolerance is not None and cost < tolerance:
                    break
                theta = theta - self.learning_rate * (g @ theta - h)
        self.features, self.weights, self.bias = list(features), theta[:-1], float(theta[-1])
        return self

    def prediction(self) -> Column:
        if self.weights is None:
            raise NotFitted("Model not trained. Call fit() first.")
        out = F.lit(self.bias)
        for c, w in zip(self.features, self.weights):
            out = out + col(c) * F.lit(float(w))
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.prediction())

    def predict_single(self, x: list[float]) -> float:
        if self.weights is None:
            raise NotFitted("Model not trained. Call fit() first.")
        if len(x) != len(self.weights):
            raise DimensionMismatch(f"Feature dimension mismatch: expected {len(self.weights)}, got {len(x)}")
        return float(np.dot(self.weights, x) + self.bias)

    def equation(self) -> str:
        parts = [(w, f"·{c}") for c, w in zip(self.features, self.weights if self.weights is not None else [])]
        if not parts:
            return "y = b"
        text = f"y = {parts[0][0]:.4f}{parts[0][1]}"
        for w, c in [*parts[1:], (self.bias, "")]:
            text += f" {'-' if w < 0 else '+'} {abs(w):.4f}{c}"
        return text

    def table(self, spark) -> DataFrame:
        """``feature, weight``, the bias last as ``(bias)``."""
        return spark.createDataFrame([*zip(self.features, map(float, self.weights)), ("(bias)", self.bias)], "feature string, weight double")

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.history)), "iter int, cost double")


def cost(y, p) -> Column:
    """Half the mean squared error."""
    d = col(y) - col(p)
    return F.avg(d * d) / 2


def coefficients(weights: DataFrame) -> DataFrame:
    """``feature, weight, magnitude, is_largest, impact_pct, sign`` of (feature, weight) rows."""
    from pyspark.sql import Window as W

    top = F.max(F.abs("weight")).over(W.partitionBy())
    size = F.abs("weight")
    return weights.select(
        "feature", "weight", size.alias("magnitude"), ((top > 0) & (size == top)).alias("is_largest"),
        F.when(top > 0, size / F.nullif(top, F.lit(0.0)) * 100).otherwise(0.0).alias("impact_pct"),
        F.when(F.col("weight") > 0, "positive").otherwise("negative").alias("sign"),
    )


def importance(df: DataFrame, weights: DataFrame, features: list[str]) -> DataFrame:
    """``feature, importance, bar_pct``: weight times the feature's (floored) deviation, most important first."""
    from pyspark.sql import Window as W

    spread = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.greatest(F.sqrt(F.coalesce(F.var_samp(col(c)), F.lit(0.0))), F.lit(1e-10)).alias("s")) for c in features]).alias("a"))
    spread = spread.select(F.explode("a").alias("a")).select("a.*")
    out = weights.join(F.broadcast(spread), "feature").select("feature", (F.col("weight") * F.col("s")).alias("importance"))  # one row a feature
    top = F.greatest(F.max(F.abs("importance")).over(W.partitionBy()), F.lit(1e-10))
    return out.withColumn("bar_pct", F.abs("importance") / top * 100).orderBy(F.abs("importance").desc(), "feature")


def endpoints(df: DataFrame, model: LinearRegression, x: str, y: str, pad: float = 0.1) -> DataFrame:
    """``x_min, x_max, y_min, y_max, y_at_x_min, y_at_x_max``: padded axis ranges (of 1 at least) and the line's ends."""
    w, b = float(model.weights[model.features.index(x)]), float(model.bias)
    row = df.agg(F.min(col(x)).alias("a"), F.max(col(x)).alias("b"), F.min(col(y)).alias("c"), F.max(col(y)).alias("d"))
    gap = lambda lo, hi: F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)) * pad
    out = row.select((F.col("a") - gap("a", "b")).alias("x_min"), (F.col("b") + gap("a", "b")).alias("x_max"), (F.col("c") - gap("c", "d")).alias("y_min"), (F.col("d") + gap("c", "d")).alias("y_max"))
    return out.withColumn("y_at_x_min", F.col("x_min") * w + b).withColumn("y_at_x_max", F.col("x_max") * w + b)
