"""Matrices and vectors as DataFrames.

A matrix is packed (``row_id, features array<double>``) or in coordinates (``i, j, v``); a vector is an array column.
Vector operators are column functions; products join on the shared index and sum.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch


def _arr(a) -> Column:
    return F.array(*[F.lit(float(x)) for x in a]) if isinstance(a, (list, tuple, np.ndarray)) else F.col(a) if isinstance(a, str) else a


def filled(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(rows).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("j"), F.lit(float(value)).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return filled(spark, n, n).withColumn("v", (F.col("i") == F.col("j")).cast("double"))


def from_values(spark: SparkSession, values: list[float], rows: int, cols: int) -> DataFrame:
    if len(values) != rows * cols:
        raise DimensionMismatch(f"Data length {len(values)} doesn't match dimensions {rows}x{cols}")
    flat = spark.range(1).select(F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("p", "v"))
    return flat.select(F.expr(f"CAST(p div {cols} AS INT)").alias("i"), F.expr(f"CAST(p % {cols} AS INT)").alias("j"), "v")


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    if len({len(r) for r in rows}) > 1:
        raise DimensionMismatch("All rows must have the same length")
    return from_values(spark, [v for r in rows for v in r], len(rows), len(rows[0]) if rows else 0)


def packed(coords: DataFrame) -> DataFrame:
    """Coordinates to ``row_id, features``; a row's cells are sorted inside their group."""
    cells = F.sort_array(F.collect_list(F.struct("j", "v")))
    return coords.groupBy(F.col("i").alias("row_id")).agg(F.transform(cells, lambda c: c["v"]).alias("features"))


def coordinates(rows: DataFrame, features: str = "features", row_id: str = "row_id") -> DataFrame:
    return rows.select(F.col(row_id).cast("int").alias("i"), F.posexplode(F.col(features).cast("array<double>")).alias("j", "v"))


def get(coords: DataFrame, i: int, j: int) -> DataFrame:
    return coords.where((F.col("i") == i) & (F.col("j") == j)).select("v")


def shape(coords: DataFrame) -> DataFrame:
    return coords.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def transpose(coords: DataFrame) -> DataFrame:
    return coords.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def at(coords: DataFrame, i: int, j: int) -> float:
    """The value of a cell; one that the matrix doesn't have is an error."""
    row = get(coords, i, j).first()
    if row is None:
        raise DimensionMismatch(f"Index ({i}, {j}) out of bounds")
    return row["v"]


def _sizes(coords: DataFrame) -> tuple[int, int]:
    return tuple(x or 0 for x in shape(coords).first())


def combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + b or a - b, by cells; matrices of unequal shapes are an error."""
    if (m := _sizes(a)) != (n := _sizes(b)):
        raise DimensionMismatch(f"Shapes {m} and {n} differ")
    return a.alias("a").join(b.alias("b"), ["i", "j"]).select("i", "j", (F.col("a.v") + sign * F.col("b.v")).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: cells meet on the shared index and are summed by place, map side first.  Unequal inner sizes are
    an error."""
    if (m := _sizes(a)[1]) != (n := _sizes(b)[0]):
        raise DimensionMismatch(f"Inner sizes {m} and {n} differ")
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def times_vector(rows: DataFrame, vector, features: str = "features") -> DataFrame:
    return rows.select("row_id", dot(F.col(features), vector).alias("v"))


def scaled(rows: DataFrame, s: float, features: str = "features") -> DataFrame:
    return rows.withColumn(features, F.transform(features, lambda x: x * F.lit(float(s))))


def _checked(a: Column, b: Column, out: Column) -> Column:
    """zip_with pads with nulls; vectors of unequal lengths are an error here."""
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("Vectors must have the same length")))


def elementwise(a, b, op: str) -> Column:
    a, b = _arr(a), _arr(b)
    ops = {
        "+": lambda x, y: x + y,
        "-": lambda x, y: x - y,
        "*": lambda x, y: x * y,
        "/": lambda x, y: F.try_divide(x, y),
        "div": lambda x, y: F.floor(F.abs(x) / F.abs(y)).cast("long") * F.signum(x * y).cast("long"),
    }
    return _checked(a, b, F.zip_with(a, b, ops[op]))


def with_scalar(a, s: float, op: str) -> Column:
    ops = {"+": lambda x: x + s, "-": lambda x: x - s, "*": lambda x: x * s, "/": lambda x: x / s}
    return F.transform(_arr(a), ops[op])


def dot(a, b) -> Column:
    a, b = _arr(a), _arr(b)
    return _checked(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def euclidean(a, b) -> Column:
    """Distance over the shorter vector's length."""
    a, b = _arr(a), _arr(b)
    n = F.least(F.size(a), F.size(b))
    square = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def argmax(a) -> Column:
    """Place of the largest element, of the last one on ties; 0 for an empty vector."""
    a = _arr(a)
    return F.when(F.size(a) == 0, 0).otherwise(F.size(a) - F.array_position(F.reverse(a), F.array_max(a))).cast("int")


def outer(spark: SparkSession, a: list[float], b: list[float]) -> DataFrame:
    one = spark.range(1)
    left = one.select(F.posexplode(_arr(a)).alias("i", "x"))
    return left.select("i", F.posexplode(F.transform(_arr(b), lambda y: y * F.col("x"))).alias("j", "v"))


def power_iteration(a: np.ndarray, steps: int = 100) -> tuple[float, np.ndarray]:
    """Largest eigenvalue and vector of a small symmetric matrix, from an even start."""
    v = np.full(len(a), 1 / np.sqrt(len(a)))
    for _ in range(steps):
        w = a @ v
        if (norm := np.linalg.norm(w)) == 0:
            return 0.0, v
        v = w / norm
    return float(v @ a @ v), v


def deflate(a: np.ndarray, value: float, vector: np.ndarray) -> np.ndarray:
    return a - value * np.outer(vector, vector)


def top_eigen(a: np.ndarray, k: int, floor: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors (rows) of a symmetric matrix, signs fixed so that each vector's sum is
    not negative; values within the floor of zero are left out."""
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(values)[::-1][:k]
    values, vectors = values[order], vectors[:, order].T
    keep = np.abs(values) > floor
    values, vectors = values[keep], vectors[keep]
    for v in vectors:
        lead = v.sum() if abs(v.sum()) > 1e-12 else v[np.argmax(np.abs(v) > 1e-12)]
        if lead < 0:
            v *= -1
    return values, vectors
