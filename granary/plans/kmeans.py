"""k-means by Lloyd's iterations: assignment and update are one pass, one job an iteration (``sums``)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter, MLError, NotFitted
from .sums import matrix, summed


def _vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _squared(features: Column, centre) -> Column:
    return F.aggregate(F.zip_with(features, _vector(centre), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _update(centroids: np.ndarray):
    """For a batch: of each centroid, the sum of the rows nearest to it (of equal ones the first), and their number."""
    k, p = centroids.shape

    def of(batch):
        x = matrix(batch.column(0), p)
        total = np.zeros((k, p + 1))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            d = np.stack([((part - c) ** 2).sum(axis=1) for c in centroids], axis=1)
            near = np.eye(k)[d.argmin(axis=1)]
            total += np.hstack([near.T @ part, near.sum(axis=0)[:, None]])
        return total.ravel()

    return of


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of its nearest centre, and the squared distance."""
    near, least = np.zeros(len(x), dtype=int), np.full(len(x), np.inf)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        closer = d < least
        near[closer], least[closer] = i, d[closer]
    return near, least


def reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int, steps: int = 20) -> np.ndarray:
    """k centres of a few weighted points: drawn with chance in proportion to weight and squared distance, then moved
    by weighted iterations.  Where fewer points differ than centres are asked for, the first repeat."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(centres) < k:
        chance = weights * _nearest(points, np.array(centres))[1]
        if not chance.sum() > 0:
            break
        centres.append(points[rng.choice(len(points), p=chance / chance.sum())])
    centres = np.array((centres * k)[:k]) if len(centres) < k else np.array(centres)
    for _ in range(steps):
        near = _nearest(points, centres)[0]
        total = np.bincount(near, weights, minlength=k)
        sums = np.stack([np.bincount(near, weights * x, minlength=k) for x in points.T], axis=1)
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    return centres


@dataclass
class KMeans:
    """``start``: "plus_plus" draws one centre a job, "scalable" takes a number of jobs that doesn't depend on k."""

    k: int
    iterations: int = 100
    tolerance: float = 1e-4
    seed: int = 42
    start: str = "plus_plus"
    centroids: np.ndarray | None = None
    inertia: float = 0.0
    n_iterations: int = 0

    def __post_init__(self):
        if self.k <= 0 or self.iterations <= 0 or not (self.tolerance > 0 and np.isfinite(self.tolerance)):
            raise InvalidParameter("k, iterations and tolerance must be positive and finite")
        if self.start not in ("plus_plus", "scalable"):
            raise InvalidParameter(f"Unknown start '{self.start}'")

    def initialize(self, packed: DataFrame, row_id: str = "row_id") -> np.ndarray:
        """k-means++ by keys: the next centre is the row of largest log(u) / D^2 for its seeded uniform number u, which
        draws a row with chance in proportion to D^2 without sorting or summing up the table."""
        u = lambda k: (F.pmod(F.xxhash64(F.col(row_id), F.lit(self.seed), F.lit(k)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
        centres = [packed.select("features").orderBy(u(0), row_id).first()["features"]]
        while len(centres) < self.k:
            d = F.array_min(F.array(*[_squared(F.col("features"), c) for c in centres]))
            key = F.when(d > 0, F.ln(u(len(centres))) / d)
            centres.append(packed.select("features", key.alias("key"), row_id).orderBy(F.col("key").desc_nulls_last(), row_id).first()["features"])
        return np.array(centres, dtype=float)

    def initialize_scalable(self, packed: DataFrame, row_id: str = "row_id", rounds: int = 5) -> np.ndarray:
        """Oversampling: in each round every row is drawn by itself, with chance in proportion to its squared distance
        from the candidates so far, some 2 k rows a round; candidates, weighted by the rows nearest to them, are then
        reduced to k on the driver.  Two jobs a round, whatever k is; draws are by seeded hashes of the row number."""
        rows = packed.select(F.col("features").cast("array<double>").alias("features"), F.col(row_id).cast("string").alias("id"))
        first = rows.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").first()
        centres = np.array([first["features"]], dtype=float)
        p = centres.shape[1]
        for k in range(rounds):
            cost = summed(rows.select("features"), 1, lambda b, c=centres: _nearest(matrix(b.column(0), p), c)[1].sum())[0]
            if not cost > 0:
                break
            u = F.pmod(F.xxhash64("id", F.lit(self.seed), F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 40))

            def draw(batches, centres=centres, cost=cost):
                for b in batches:
                    if b.num_rows:
                        chance = 2 * self.k * _nearest(matrix(b.column(0), p), centres)[1] / cost
                        yield b.select([0]).filter(pa.array(b.column(1).to_numpy() < chance))

            # 2 k rows on average
            drawn = rows.select("features", u.alias("u")).mapInArrow(draw, "features array<double>").collect()
            if drawn:
                centres = np.unique(np.vstack([centres, [r["features"] for r in drawn]]), axis=0)
        n = len(centres)
        counts = summed(rows.select("features"), n, lambda b: np.bincount(_nearest(matrix(b.column(0), p), centres)[0], minlength=n))
        return reduced(centres, counts, self.k, self.seed)

    def distances(self) -> Column:
        if self.centroids is None:
            raise NotFitted("Model not fitted. Call fit() first.")
        return F.array(*[_squared(F.col("features"), c) for c in self.centroids])

    def label(self) -> Column:
        """Nearest centroid; of equal ones the first."""
        d = self.distances()
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def fit(self, packed: DataFrame, init=None, row_id: str = "row_id") -> KMeans:
        """``packed`` has ``features``; empty clusters move to the origin; ends when no centroid moves by the tolerance."""
        cached = packed.select(*([row_id] if row_id in packed.columns else [F.monotonically_increasing_id().alias(row_id)]), F.col("features").cast("array<double>")).persist()
        try:
            n = cached.count()
            if n < self.k:
                raise MLError(f"Number of samples ({n}) must be >= n_clusters ({self.k})")
            self.centroids = np.array(init, dtype=float) if init is not None else (self.initialize_scalable if self.start == "scalable" else self.initialize)(cached, row_id)
            p = self.centroids.shape[1]
            for i in range(self.iterations):
                total = summed(cached.select("features"), self.k * (p + 1), _update(self.centroids)).reshape(self.k, p + 1)
                new = np.divide(total[:, :p], total[:, p:], out=np.zeros((self.k, p)), where=total[:, p:] > 0)
                shift = np.sqrt(((new - self.centroids) ** 2).sum(axis=1)).max()
                self.centroids, self.n_iterations = new, i + 1
                if shift < self.tolerance:
                    break
            self.inertia = cached.agg(F.sum(F.array_min(self.distances()))).first()[0]
        finally:
            cached.unpersist()
        return self

    def predict(self, packed: DataFrame, name: str = "label") -> DataFrame:
        return packed.withColumn("features", F.col("features").cast("array<double>")).withColumn(name, self.label())

    def fit_predict(self, packed: DataFrame, init=None) -> DataFrame:
        return self.fit(packed, init).predict(packed)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cluster int, centroid array<double>")
