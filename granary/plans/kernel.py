"""Principal components in a kernel's feature space, through landmarks (Nyström).

A bounded number of rows are landmarks; every row is described by its kernel values against them, whitened so that inner
products of landmarks' descriptions are the kernel itself.  Means and covariances of the descriptions are one pass of
matrix products, components an eigenproblem of the landmarks' size.  With every row a landmark this is kernel PCA itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyData, InvalidParameter, NotFitted
from ..operators.linalg import top_eigen
from .sums import matrix, summed

KERNELS = {
    "rbf": lambda x, y, gamma: np.exp(-gamma * np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0)),
    "polynomial": lambda x, y, gamma: (gamma * x @ y.T + 1) ** 3,
    "linear": lambda x, y, gamma: x @ y.T,
}
#: Eigenvalues of the landmarks' kernel below this share of the largest are left out of the whitening.
RANK = 1e-10


@dataclass
class KernelPCA:
    """``landmarks`` rows, those of smallest seeded hash of their vectors, stand for the feature space."""

    k: int
    kernel: str = "rbf"
    gamma: float = 1.0
    landmarks: int = 256
    seed: int = 0
    points: np.ndarray | None = None
    explained_variance: np.ndarray | None = None

    def __post_init__(self):
        if self.k < 1 or self.landmarks < self.k or not self.gamma > 0 or self.kernel not in KERNELS:
            raise InvalidParameter("k must be positive, landmarks k or more, gamma positive, and the kernel one of " + ", ".join(KERNELS))

    def _described(self, x: np.ndarray) -> np.ndarray:
        return KERNELS[self.kernel](x, self.points, self.gamma) @ self.whitening

    def fit(self, packed: DataFrame, features: str = "features") -> KernelPCA:
        """Rows whose vector is null or holds a null are left out; vectors of several lengths and no rows are errors.

        Equal vectors are one landmark at most; fewer components than k are kept where the kernel has no more.
        """
        rows = packed.select(F.col(features).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
        n, p, widest = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
        if not n:
            raise EmptyData("No vectors")
        if p != widest:
            raise DimensionMismatch("Vectors must have the same length")
        # ``landmarks`` rows
        self.points = np.array([r["x"] for r in rows.distinct().orderBy(F.xxhash64("x", F.lit(self.seed)), "x").limit(self.landmarks).collect()], dtype=float)
        values, vectors = np.linalg.eigh(KERNELS[self.kernel](self.points, self.points, self.gamma))
        kept = values > RANK * values[-1]
        self.whitening = vectors[:, kept] / np.sqrt(values[kept])
        m = int(kept.sum())

        def moments(batch):
            d = self._described(matrix(batch.column(0), p))
            return np.r_[d.sum(axis=0), (d.T @ d).ravel()]

        total = summed(rows, m + m * m, moments)
        self.mean = total[:m] / n
        self.explained_variance, self.components = top_eigen((total[m:].reshape(m, m) - n * np.outer(self.mean, self.mean)) / n, min(self.k, m))
        return self

    def transform(self, packed: DataFrame, features: str = "features", name: str = "projected") -> DataFrame:
        """Adds each row's coordinates along the components; null for a vector that is null, holds a null or has another
        length."""
        if self.points is None:
            raise NotFitted("Model not fitted. Call fit() first.")
        p, x = self.points.shape[1], F.col(features).cast("array<double>")
        usable = (F.size(x) == p) & ~F.exists(x, lambda v: v.isNull())
        given = packed.drop(name).withColumn(name, F.when(F.coalesce(usable, F.lit(False)), x).otherwise(F.array_repeat(F.lit(float("nan")), p)))

        def run(batches):
            for b in batches:
                d = matrix(b.column(b.num_columns - 1), p)
                out = (self._described(d) - self.mean) @ self.components.T
                told = pa.array([None if np.isnan(x).any() else v.tolist() for x, v in zip(d, out)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], told], names=b.schema.names)

        return given.mapInArrow(run, given.schema)
