"""Feed-forward networks.

Training row by row in row order can't be split, so it is one grouped-map task; ``fit_minibatch`` is the variant that
scales: mini-batches by key, gradients summed by matrix products, one job a step, with L1, L2 or both.  Prediction is
column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidParameter, NotFitted
from ..functions.activation import NAMES, activate, initialize, np_activate, np_derivative
from ..operators.linalg import argmax
from .sums import matrix, summed


@dataclass
class Network:
    sizes: list[int]
    activations: list[str]
    learning_rate: float = 0.5
    seed: int = 0
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    history: pd.DataFrame | None = None

    def __post_init__(self):
        if len(self.sizes) < 2 or len(self.activations) != len(self.sizes) - 1 or any(a not in NAMES for a in self.activations):
            raise InvalidParameter("A network needs two sizes at least, and an activation for each layer after the first")
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            for n_in, n_out, a in zip(self.sizes, self.sizes[1:], self.activations):
                self.weights.append(initialize("he" if a == "relu" else "xavier", n_in, n_out, rng))
                self.biases.append(np.zeros(n_out))

    def forward(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(pre-activations, activations) of one row or of rows."""
        zs, outs = [], [np.asarray(x, dtype=float)]
        for w, b, a in zip(self.weights, self.biases, self.activations):
            zs.append(outs[-1] @ w.T + b)
            outs.append(np_activate(a, zs[-1]))
        return zs, outs

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """(gradients of weights, of biases, loss) of one row, all by the weights before the step."""
        zs, outs = self.forward(x)
        d = (outs[-1] - y) * np_derivative(self.activations[-1], zs[-1])
        gw, gb = [], []
        for k in range(len(self.weights) - 1, -1, -1):
            gw.insert(0, np.outer(d, outs[k]))
            gb.insert(0, d)
            if k:
                d = self.weights[k].T @ d * np_derivative(self.activations[k - 1], zs[k - 1])
        return gw, gb, float(((outs[-1] - y) ** 2).mean())

    def train_epoch(self, x: np.ndarray, y: np.ndarray) -> float:
        """One step a row, in order; the mean of the losses before the steps."""
        losses = []
        for row, want in zip(x, y):
            gw, gb, loss = self.gradients(row, want)
            losses.append(loss)
            for k in range(len(self.weights)):
                self.weights[k] = self.weights[k] - self.learning_rate * gw[k]
                self.biases[k] = self.biases[k] - self.learning_rate * gb[k]
        return float(np.mean(losses)) if losses else 0.0

    def accuracy(self, x: np.ndarray, y: np.ndarray) -> float:
        last = lambda a: a.shape[1] - 1 - np.argmax(a[:, ::-1], axis=1)
        return float((last(self.forward(x)[1][-1]) == last(y)).mean() * 100) if len(x) else 0.0

    def fit(self, df: DataFrame, features: str, targets: str, row_id: str, epochs: int, snapshot_every: int = 0) -> Network:
        """Row-by-row training in the order of ``row_id``, in one task; keeps the history of losses and accuracies."""
        start = (list(self.sizes), list(self.activations), self.learning_rate, self.seed, self.weights, self.biases)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            net = Network(*start)
            pdf = pdf.sort_values("r")
            x, y = np.stack(pdf["x"]), np.stack(pdf["y"])
            rows = []
            for e in range(epochs):
                loss = net.train_epoch(x, y)
                keep = e == epochs - 1 or (snapshot_every > 0 and e % snapshot_every == 0)
                flat = np.concatenate([np.r_[w.ravel(), b] for w, b in zip(net.weights, net.biases)]).tolist() if keep else None
                rows.append((e, loss, net.accuracy(x, y), flat))
            return pd.DataFrame(rows, columns=["epoch", "loss", "accuracy", "parameters"])

        data = df.select(F.col(row_id).alias("r"), F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))
        self.history = data.groupBy().applyInPandas(run, "epoch int, loss double, accuracy double, parameters array<double>").toPandas().sort_values("epoch")
        if len(self.history):
            self._load(np.array(self.history["parameters"].iloc[-1]))
        return self

    def _load(self, flat: np.ndarray) -> None:
        at = 0
        for k, (n_in, n_out) in enumerate(zip(self.sizes, self.sizes[1:])):
            self.weights[k] = flat[at : at + n_in * n_out].reshape(n_out, n_in)
            self.biases[k] = flat[at + n_in * n_out : at + n_in * n_out + n_out]
            at += n_in * n_out + n_out

    def _flat(self) -> np.ndarray:
        return np.concatenate([np.r_[w.ravel(), b] for w, b in zip(self.weights, self.biases)])

    def summed_gradients(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradients of all weights and biases, layer by layer, summed over rows; then the sum of losses and the rows."""
        zs, outs = self.forward(x)
        d = (outs[-1] - y) * np_derivative(self.activations[-1], zs[-1])
        parts = []
        for k in range(len(self.weights) - 1, -1, -1):
            parts.insert(0, np.r_[(d.T @ outs[k]).ravel(), d.sum(axis=0)])
            if k:
                d = d @ self.weights[k] * np_derivative(self.activations[k - 1], zs[k - 1])
        return np.r_[np.concatenate(parts), ((outs[-1] - y) ** 2).mean(axis=1).sum(), len(x)]

    def fit_minibatch(self, df: DataFrame, features: str, targets: str, steps: int, parts: int = 1, key: Column | None = None, l1: float = 0.0, l2: float = 0.0) -> Network:
        """Gradient steps over mini-batches: step k takes the rows whose key leaves k on division by ``parts``.

        The key is an integer column (without one, the seeded hash of features and targets), so a mini-batch is the same
        however rows are partitioned.  Tasks sum their rows' gradients by matrix products, one job a step.  l2 adds its
        share of the weights to the mean gradient, l1 shrinks weights towards zero after the step (both: elastic net);
        biases are free of either.  A batch without rows changes nothing; ``history`` has each step's mean loss.  Rows
        with null features or targets are left out; vectors of other lengths than the layers' are an error.
        """
        if parts < 1 or l1 < 0 or l2 < 0:
            raise InvalidParameter("parts must be 1 or more, l1 and l2 not negative")
        data = df.select(F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"), *([key.alias("key")] if key is not None else []))
        data = data.where("x IS NOT NULL AND y IS NOT NULL")
        of = F.col("key") if key is not None else F.xxhash64("x", "y", F.lit(self.seed))
        data = data.select("x", "y", F.pmod(of, F.lit(parts)).alias("part")).persist()
        n_in, n_out, losses = self.sizes[0], self.sizes[-1], []
        shrunk = np.concatenate([np.r_[np.ones(w.size), np.zeros(b.size)] for w, b in zip(self.weights, self.biases)])
        try:
            if not data.where((F.size("x") != n_in) | (F.size("y") != n_out)).isEmpty():
                raise DimensionMismatch(f"Features must have {n_in} numbers and targets {n_out}")
            for k in range(steps):
                start = (list(self.sizes), list(self.activations), self.learning_rate, self.seed, list(self.weights), list(self.biases))
                batch = data.where(F.col("part") == k % parts).select("x", "y")
                total = summed(batch, len(shrunk) + 2, lambda b, start=start: Network(*start).summed_gradients(matrix(b.column(0), n_in), matrix(b.column(1), n_out)))
                if not total[-1]:
                    continue
                flat = self._flat()
                flat = flat - self.learning_rate * (total[:-2] / total[-1] + l2 * shrunk * flat)
                limit = self.learning_rate * l1 * shrunk
                self._load(np.sign(flat) * np.maximum(np.abs(flat) - limit, 0))
                losses.append((k, total[-2] / total[-1]))
        finally:
            data.unpersist()
        self.history = pd.DataFrame(losses, columns=["step", "loss"])
        return self

    def table(self, spark) -> DataFrame:
        """``layer, unit, input, weight``: input -1 is the bias."""
        rows = [(k, u, i, float(v)) for k, (w, b) in enumerate(zip(self.weights, self.biases)) for u in range(len(w)) for i, v in [(-1, b[u]), *enumerate(w[u])]]
        return spark.createDataFrame(rows, "layer int, unit int, input int, weight double")

    def output(self, features: Column) -> Column:
        """The last layer's activations as an array column."""
        out = features.cast("array<double>")
        for w, b, a in zip(self.weights, self.biases, self.activations):
            units = [F.aggregate(F.zip_with(out, F.array(*[F.lit(float(v)) for v in row]), lambda x, y: x * y), F.lit(float(c)), lambda s, x: s + x) for row, c in zip(w, b)]
            out = F.array(*[activate(a, u) for u in units])
        return out

    def predict(self, df: DataFrame, features: str = "features", name: str = "output") -> DataFrame:
        if not self.weights:
            raise NotFitted("Network not initialised")
        return df.withColumn(name, self.output(F.col(features)))

    def predict_class(self, df: DataFrame, features: str = "features", name: str = "class") -> DataFrame:
        return df.withColumn(name, argmax(self.output(F.col(features))))


def mse_loss(p: np.ndarray, t: np.ndarray) -> float:
    if np.shape(p) != np.shape(t):
        raise DimensionMismatch("Predictions and targets must have the same length")
    return float(np.mean((np.asarray(p, float) - np.asarray(t, float)) ** 2))
