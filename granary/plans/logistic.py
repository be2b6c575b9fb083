"""Logistic regression by batch gradient descent; several classes by one against the rest.

The gradients of all classes are summed in the same pass, one job an iteration (``sums``); nothing is chained from one
iteration to the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyData, InvalidParameter, MLError, NotFitted
from ..functions.activation import sigmoid
from ..operators.stats import col, complete
from .sums import matrix, summed

#: Distinct labels, each of which takes a model.
MOST_LABELS = 1000


@dataclass
class LogisticRegression:
    learning_rate: float = 0.01
    iterations: int = 1000
    tolerance: float = 1e-4
    features: list[str] = field(default_factory=list)
    labels: list[float] = field(default_factory=list)
    weights: np.ndarray | None = None  # a row for each model
    biases: np.ndarray | None = None
    n_iterations: int = 0

    def __post_init__(self):
        for ok, what in ((self.learning_rate > 0 and np.isfinite(self.learning_rate), "Learning rate"), (self.iterations > 0, "Iterations"), (self.tolerance > 0 and np.isfinite(self.tolerance), "Tolerance")):
            if not ok:
                raise InvalidParameter(f"{what} must be positive and finite")

    def _score(self, k: int) -> Column:
        z = F.lit(float(self.biases[k]))
        for c, w in zip(self.features, self.weights[k]):
            z = z + col(c) * F.lit(float(w))
        return sigmoid(z)

    def fit(self, df: DataFrame, features: list[str], label: str) -> LogisticRegression:
        """Labels are told apart by their sorted distinct values; two are learned by one model, more by one each; over
        MOST_LABELS of them are an error, as a number is no class.  Rows with a null among features and label are left
        out."""
        df = complete(df, [*features, label])
        rows = df.groupBy(col(label).alias("y")).count().orderBy("y").limit(MOST_LABELS + 1).collect()
        if len(rows) > MOST_LABELS:
            raise MLError(f"Over {MOST_LABELS} distinct labels")
        if not rows:
            raise EmptyData("Cannot fit on empty data")
        if len(rows) < 2:
            raise MLError("Need at least 2 classes for classification")
        self.features, self.labels = list(features), [r["y"] for r in rows]
        n, p = sum(r["count"] for r in rows), len(features)
        models = [1] if len(rows) == 2 else list(range(len(rows)))
        targets = np.array([self.labels[m] for m in models])
        self.weights, self.biases = np.zeros((len(models), p)), np.zeros(len(models))
        cached = df.select(F.array(*[col(c) for c in features]).alias("x"), col(label).alias("y")).persist()
        live = np.ones(len(models), dtype=bool)
        try:
            self.n_iterations = 0
            while live.any() and self.n_iterations < self.iterations:
                w, b, t = self.weights[live], self.biases[live], targets[live]

                def gradient(batch, w=w, b=b, t=t):
                    x, y = matrix(batch.column(0), p), batch.column(1).to_numpy(zero_copy_only=False)
                    with np.errstate(over="ignore"):
                        e = 1 / (1 + np.exp(-(x @ w.T + b))) - (y[:, None] == t)
                    return np.hstack([e.T @ x, e.sum(axis=0)[:, None]]).ravel()

                step = self.learning_rate * summed(cached, len(w) * (p + 1), gradient).reshape(len(w), p + 1) / n
                self.n_iterations += 1
                self.weights[live] -= step[:, :-1]
                self.biases[live] -= step[:, -1]
                live[live] = np.abs(step).max(axis=1) >= self.tolerance
        finally:
            cached.unpersist()
        return self

    def probabilities(self) -> Column:
        """Array of class probabilities, in the order of ``labels``."""
        if self.weights is None:
            raise NotFitted("Model not trained. Call fit() first.")
        scores = [self._score(k) for k in range(len(self.weights))]
        if len(scores) == 1:
            return F.array(1 - scores[0], scores[0])
        total = sum(scores[1:], scores[0])
        return F.array(*[F.when(total > 0, s / total).otherwise(s) for s in scores])

    def predict_proba(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        return df.withColumn(name, self.probabilities())

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Index of the likeliest class; of equal ones the last."""
        from ..operators.linalg import argmax

        return df.withColumn(name, argmax(self.probabilities()))

    def table(self, spark) -> DataFrame:
        rows = [(k, c, float(w)) for k in range(len(self.weights)) for c, w in zip([*self.features, "(bias)"], [*self.weights[k], self.biases[k]])]
        return spark.createDataFrame(rows, "model int, feature string, weight double")
