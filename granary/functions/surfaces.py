"""Analytic loss surfaces: values, gradients, heat maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Name, difficulty, x bounds, y bounds, start, minima, description.
SURFACES = (
    ("Quadratic", 1, (-3.0, 3.0), (-3.0, 3.0), (2.0, 2.0), ((0.0, 0.0),), "A simple bowl"),
    ("Rosenbrock", 3, (-2.0, 2.0), (-1.0, 3.0), (-1.0, 1.0), ((1.0, 1.0),), "A narrow curved valley"),
    ("Saddle", 2, (-2.0, 2.0), (-2.0, 2.0), (1.0, 1.0), ((0.0, 0.0),), "A saddle point at the origin"),
    ("Beale", 4, (-4.5, 4.5), (-4.5, 4.5), (1.0, 1.0), ((3.0, 0.5),), "Flat with steep edges"),
    ("Himmelblau", 4, (-5.0, 5.0), (-5.0, 5.0), (0.0, 0.0), ((3.0, 2.0), (-2.805118, 3.131312), (-3.779310, -3.283186), (3.584428, -1.848126)), "Four equal minima"),
    ("Rastrigin", 5, (-5.12, 5.12), (-5.12, 5.12), (2.0, 2.0), ((0.0, 0.0),), "Many local minima"),
)
NAMES = tuple(s[0] for s in SURFACES)
_TWO_PI = 2 * math.pi


def _power(v, k: int):
    out = 1
    for _ in range(k):
        out = out * v
    return out


def _squares(name: str, x, y) -> list[tuple]:
    """The terms of a weighted sum of squares: (weight, residual, its slopes by x and by y)."""
    if name == "Quadratic":
        return [(1, x, 1, 0), (1, y, 0, 1)]
    if name == "Saddle":
        return [(1, x, 1, 0), (-1, y, 0, 1)]
    if name == "Rosenbrock":
        return [(1, 1 - x, -1, 0), (100, y - _power(x, 2), -2 * x, 1)]
    if name == "Himmelblau":
        return [(1, _power(x, 2) + y - 11, 2 * x, 1), (1, x + _power(y, 2) - 7, 1, 2 * y)]
    if name == "Beale":
        return [(1, level - x * (1 - _power(y, k)), _power(y, k) - 1, k * x * _power(y, k - 1)) for k, level in enumerate((1.5, 2.25, 2.625), 1)]
    raise ValueError(name)


def _waves(v):
    """Rastrigin's share of one coordinate, and its slope."""
    cos, sin = (F.cos, F.sin) if isinstance(v, Column) else (math.cos, math.sin)
    return _power(v, 2) + 10 * (1 - cos(_TWO_PI * v)), 2 * v + 10 * _TWO_PI * sin(_TWO_PI * v)


def value(name: str, x, y):
    """The surface at (x, y), columns or numbers."""
    if name == "Rastrigin":
        return _waves(x)[0] + _waves(y)[0]
    return sum(weight * residual * residual for weight, residual, _, _ in _squares(name, x, y))


def gradient(name: str, x, y):
    if name == "Rastrigin":
        return _waves(x)[1], _waves(y)[1]
    terms = _squares(name, x, y)
    return sum(2 * w * r * dx for w, r, dx, _ in terms), sum(2 * w * r * dy for w, r, _, dy in terms)


def chosen(name: Column, of) -> Column:
    """``of(surface)`` for the surface a column names."""
    out = F.lit(None)
    for n in NAMES:
        out = F.when(name == n, of(n)).otherwise(out)
    return out


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, n, d, *x, *y, *s, [list(m) for m in minima], about) for i, (n, d, x, y, s, minima, about) in enumerate(SURFACES)]
    return spark.createDataFrame(rows, "position int, name string, difficulty int, x_min double, x_max double, y_min double, y_max double, start_x double, start_y double, minima array<array<double>>, description string")


def heatmap(spark: SparkSession, name: str, resolution: int) -> DataFrame:
    """``row, col, x, y, v, t``: the surface on a grid, and its log-normalised heat (1 where it isn't finite)."""
    _, _, (x0, x1), (y0, y1), *_ = next(s for s in SURFACES if s[0] == name)
    step = lambda a, b, k: F.lit(a) + F.lit(b - a) * k / F.lit(float(max(resolution - 1, 1)))
    grid = spark.range(resolution).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))).alias("col"))
    grid = grid.withColumns({"x": step(x0, x1, F.col("col")), "y": step(y0, y1, F.col("row"))})
    return heat(grid.withColumn("v", value(name, F.col("x"), F.col("y"))))


def heat(grid: DataFrame) -> DataFrame:
    finite = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    w = W.partitionBy()
    low, high = F.min(finite).over(w), F.max(finite).over(w)
    t = F.ln(F.col("v") - low + 1) / F.nullif(F.ln(high - low + 1), F.lit(0.0))
    return grid.withColumn("t", F.when(finite.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))))


def heat_color(t: Column) -> Column:
    """``hsl`` text: from blue (cold, dark) to red (hot, light)."""
    return F.format_string("hsl(%.0f, 80%%, %.0f%%)", (1 - t) * 240, (0.3 + 0.4 * t) * 100)


def correlation_color(r: Column) -> Column:
    """``rgb`` text: red for positive, blue for negative, white at zero."""
    rest = F.floor(255 * (1 - F.abs(r))).cast("int")
    return F.when(r >= 0, F.format_string("rgb(255,%d,%d)", rest, rest)).otherwise(F.format_string("rgb(%d,%d,255)", rest, rest))
