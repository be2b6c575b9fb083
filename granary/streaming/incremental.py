"""Incremental fits: moments of micro-batches are merged exactly, and the model is refitted from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import Moments, moments
from ..plans.linear import LinearRegression, _system


def merge(a: Moments | None, b: Moments) -> Moments:
    """Moments of both tables together (Chan et al.)."""
    if a is None or not a.n:
        return b
    if not b.n:
        return a
    n, d = a.n + b.n, b.means - a.means
    return Moments(a.columns, n, a.means + d * b.n / n, a.products + b.products + np.outer(d, d) * a.n * b.n / n)


class IncrementalLinear:
    """A linear regression that learns from a stream; its state is one small matrix, whatever has been seen."""

    def __init__(self, features: list[str], target: str, learning_rate: float = 0.01, iterations: int = 100):
        self.features, self.target, self.iterations = list(features), target, iterations
        self.model, self.seen = LinearRegression(learning_rate).initialize(features), None
        self.batches: set[int] = set()

    def partial_fit(self, df: DataFrame, batch: int | None = None) -> IncrementalLinear:
        """Learn from one more table; a batch that comes again after a restart is not counted twice."""
        if batch is not None and batch in self.batches:
            return self
        self.seen = merge(self.seen, moments(df, [*self.features, self.target]))
        if batch is not None:
            self.batches.add(batch)
        if self.seen.n:
            g, h, _ = _system(self.seen)
            theta = np.append(self.model.weights, self.model.bias)
            for _ in range(self.iterations):
                theta = theta - self.model.learning_rate * (g @ theta - h)
            self.model.weights, self.model.bias = theta[:-1], float(theta[-1])
        return self

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(lambda df, i: self.partial_fit(df, i) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_stats(stream: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    """``window_start, n, mean, std_dev`` of tumbling windows; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"))
        .select(F.col("w.start").alias("window_start"), "n", "mean", "std_dev")
    )
