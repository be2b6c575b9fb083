"""Singular values and vectors of tall and of wide tables, without a matrix of moments.

Tall: tasks reduce their rows to triangular QR factors, a chunk at a time, and the factors are reduced by a tree of tasks
until one is left, whose singular values and right vectors are the table's.  Small singular values keep their digits,
which squares in a matrix of moments would lose.  Wide: a seeded sketch of few columns, sharpened by power iterations, is
made orthogonal the same way, and the table is projected on it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyData, InvalidParameter, NotFitted
from ..lineage import materialise
from .sums import matrix, summed

#: Rows that are factored at once, and factors that one task of the tree reduces.
CHUNK, BRANCHES = 4096, 16


def _factor(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, its diagonal not negative."""
    r = np.linalg.qr(rows, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if len(r) else r


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], names=["x"])


def triangular(rows: DataFrame, p: int) -> np.ndarray:
    """The triangular QR factor of a table of vectors ``x`` of length p; p x p at most.

    Every level of the tree has a BRANCHES-th of the tasks, and a task holds two factors and a chunk of rows.
    """

    def reduce(batches):
        r = np.zeros((0, p))
        for b in batches:
            x = matrix(b.column(0), p)
            for at in range(0, len(x), CHUNK):
                r = _factor(np.vstack([r, x[at : at + CHUNK]]))
        yield _batch(r)

    factors = rows.select("x").mapInArrow(reduce, "x array<double>")
    tasks = factors.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // BRANCHES)
        factors = materialise(factors).coalesce(tasks).mapInArrow(reduce, "x array<double>")
    # p rows
    found = [r["x"] for r in factors.collect()]
    return np.array(found, dtype=float).reshape(-1, p)


def _signed(v: np.ndarray) -> np.ndarray:
    """Rows with signs fixed: the entry of largest size is positive."""
    return v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]


@dataclass
class SVD:
    """``values`` in descending order, and ``vectors``, the right ones, a row each."""

    k: int
    sketch: bool = False
    oversampling: int = 10
    powers: int = 3
    seed: int = 0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def __post_init__(self):
        if self.k < 1 or self.oversampling < 0 or self.powers < 0:
            raise InvalidParameter("k must be positive, oversampling and powers not negative")

    def fit(self, packed: DataFrame, features: str = "features") -> SVD:
        """The k largest values and vectors of the matrix of all rows' vectors, neither centred nor scaled.

        Rows whose vector is null or holds a null are left out; vectors of several lengths, and no rows at all, are
        errors; k beyond the shorter side gives as many as there are.
        """
        rows = packed.select(F.col(features).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
        n, p, widest = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
        if not n or not p:
            raise EmptyData("No vectors")
        if p != widest:
            raise DimensionMismatch("Vectors must have the same length")
        if not self.sketch:
            _, s, v = np.linalg.svd(triangular(rows, p), full_matrices=False)
        else:
            width = min(p, self.k + self.oversampling)
            basis = np.random.default_rng(self.seed).normal(size=(p, width))
            for step in range(self.powers + 1):
                # rows of the table times the basis, orthogonal by their triangular factor
                inverse = np.linalg.pinv(triangular(_times(rows, basis), width))
                projected = summed(rows, width * p, lambda b, m=basis @ inverse: ((matrix(b.column(0), p) @ m).T @ matrix(b.column(0), p)).ravel()).reshape(width, p)
                if step < self.powers:
                    basis = np.linalg.qr(projected.T)[0]
            _, s, v = np.linalg.svd(projected, full_matrices=False)
        k = min(self.k, n, len(s))
        self.values, self.vectors = s[:k], _signed(v[:k])
        return self

    def transform(self, packed: DataFrame, features: str = "features", name: str = "projected") -> DataFrame:
        """Adds each row's coordinates along the vectors (left vectors times values); null for a vector with a null or of
        another length."""
        if self.vectors is None:
            raise NotFitted("Model not fitted. Call fit() first.")
        x = F.col(features).cast("array<double>")
        along = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in v]), lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c) for v in self.vectors]
        return packed.withColumn(name, F.when((F.size(x) == self.vectors.shape[1]) & ~F.exists(x, lambda v: v.isNull()), F.array(*along)))

    def table(self, spark) -> DataFrame:
        """``component, value, vector``."""
        return spark.createDataFrame([(k + 1, float(s), v.tolist()) for k, (s, v) in enumerate(zip(self.values, self.vectors))], "component int, value double, vector array<double>")


def _times(rows: DataFrame, basis: np.ndarray) -> DataFrame:
    p = len(basis)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield _batch(matrix(b.column(0), p) @ basis)

    return rows.select("x").mapInArrow(run, "x array<double>")
