"""Principal components of the correlation matrix: one aggregate, then a small eigenproblem on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MLError, NotFitted
from ..operators.linalg import top_eigen
from ..operators.stats import FLOOR, col, moments

#: Variances (of standardised columns) that differ by less can't be told apart.
EQUAL = 1e-9


@dataclass
class PCA:
    k: int
    columns: list[str] = field(default_factory=list)
    components: np.ndarray | None = None
    explained_variance: np.ndarray | None = None

    def fit(self, df: DataFrame, columns: list[str]) -> PCA:
        if self.k > len(columns):
            raise MLError(f"n_components ({self.k}) cannot exceed n_features ({len(columns)})")
        m = moments(df, columns)
        if m.n < 2:
            raise MLError("Need at least 2 samples for PCA")
        values, vectors = top_eigen(m.correlation(), self.k)
        if len(values) < self.k:
            raise MLError(f"Could only find {len(values)} significant components (requested {self.k})")
        self.columns, self.means, self.stds = list(columns), m.means, m.std()
        self.components, self.explained_variance = vectors, values
        return self

    def along(self, directions: list[list[float]]) -> PCA:
        """Components in the order and with the signs of the directions they lie along, whatever their variances.

        Where variances are equal, any turn of the components has them too, and the directions themselves are taken.
        """
        if self.components is None:
            raise NotFitted("PCA not fitted. Call fit() first.")
        if len(directions) != len(self.components):
            raise MLError(f"Expected {len(self.components)} directions, not {len(directions)}")
        left, components, variances = list(range(len(self.components))), [], []
        for d in np.asarray(directions, dtype=float):
            weights = self.components @ d
            lead = max(left, key=lambda k: abs(weights[k]))
            same = [k for k in range(len(weights)) if abs(self.explained_variance[k] - self.explained_variance[lead]) <= EQUAL]
            v = weights[same] @ self.components[same]
            for c in components:
                v = v - (v @ c) * c
            norm = np.linalg.norm(v)
            components.append(v / norm if norm > EQUAL else self.components[lead])
            variances.append(self.explained_variance[lead])
            left.remove(lead)
        self.components, self.explained_variance = np.array(components), np.array(variances)
        return self

    def explained_variance_ratio(self) -> np.ndarray:
        """Shares of the kept components' variance; they sum to 1."""
        return self.explained_variance / self.explained_variance.sum()

    def singular_values(self) -> np.ndarray:
        return np.sqrt(np.clip(self.explained_variance, 0, None))

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Adds a column for each component; a constant column is only centred."""
        if self.components is None:
            raise NotFitted("PCA not fitted. Call fit() first.")
        z = [(col(c) - F.lit(float(m))) / F.lit(float(s) if s > FLOOR else 1.0) for c, m, s in zip(self.columns, self.means, self.stds)]
        out = {}
        for k, v in enumerate(self.components):
            e = F.lit(0.0)
            for x, w in zip(z, v):
                e = e + x * F.lit(float(w))
            out[f"{prefix}{k + 1}"] = e
        return df.withColumns(out)

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def table(self, spark) -> DataFrame:
        """``component, feature, loading, explained_variance, ratio``."""
        ratio = self.explained_variance_ratio()
        rows = [(k + 1, c, float(x), float(self.explained_variance[k]), float(ratio[k])) for k, v in enumerate(self.components) for c, x in zip(self.columns, v)]
        return spark.createDataFrame(rows, "component int, feature string, loading double, explained_variance double, ratio double")
