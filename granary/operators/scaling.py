"""Scalers: fitted by one aggregate, applied as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, EmptyData, InvalidParameter, NotFitted
from .stats import FLOOR, col, percentiles
from .table import numbered


class Transformer:
    """What can be fitted to columns of a table and then transform them."""

    columns: list[str] | None = None

    def fit(self, df: DataFrame, columns: list[str]):
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self._forward)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, self._backward)

    def fit_transform(self, df: DataFrame, columns: list[str]) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def _apply(self, df: DataFrame, of) -> DataFrame:
        if self.columns is None:
            raise NotFitted("Scaler not fitted. Call fit() first.")
        if absent := [c for c in self.columns if c not in df.columns]:
            raise DimensionMismatch(f"Feature dimension mismatch: missing {absent}")
        return df.withColumns({c: of(i, col(c)) for i, c in enumerate(self.columns)})

    def _forward(self, i: int, x: Column) -> Column:
        raise NotImplementedError

    def _backward(self, i: int, x: Column) -> Column:
        raise NotImplementedError

    def _aggregate(self, df: DataFrame, columns: list[str], *of):
        row = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in enumerate(of)]).first()
        if not row["n"]:
            raise EmptyData("Cannot fit on empty data")
        self.columns = list(columns)
        return [[row[f"{k}_{i}"] for i in range(len(columns))] for k in range(len(of))]

    def _quantiles(self, df: DataFrame, columns: list[str], shares: list[float]) -> list[list[float]]:
        found = {r["column"]: r["q"] for r in percentiles(df, columns, shares).collect()}  # a row a column
        if absent := [c for c in columns if c not in found]:
            raise EmptyData(f"Cannot fit on empty data: no value in {absent}")
        self.columns = list(columns)
        return [found[c] for c in columns]

    def describe(self, spark) -> DataFrame:
        """``column, scale, offset``."""
        rows = [(c, float(s), float(o)) for c, s, o in zip(self.columns or [], self.scale(), self.offset())]
        return spark.createDataFrame(rows, "column string, scale double, offset double")


class StandardScaler(Transformer):
    """(x - mean) / population deviation; a deviation under the floor counts as 1."""

    def fit(self, df, columns):
        self.mean, std = self._aggregate(df, columns, lambda c: F.avg(col(c)), lambda c: F.stddev_pop(col(c)))
        self.std = [1.0 if s < FLOOR else s for s in std]
        return self

    def _forward(self, i, x):
        return (x - F.lit(self.mean[i])) / F.lit(self.std[i])

    def _backward(self, i, x):
        return x * F.lit(self.std[i]) + F.lit(self.mean[i])

    def scale(self):
        return self.std

    def offset(self):
        return self.mean


class MinMaxScaler(Transformer):
    """To a range; a constant column becomes the range's lower end.  NaN values are ignored in the fit."""

    def __init__(self, low: float = 0.0, high: float = 1.0):
        if not low < high:
            raise InvalidParameter("min must be less than max")
        self.low, self.high = float(low), float(high)

    def fit(self, df, columns):
        clean = lambda c: F.when(~F.isnan(col(c)), col(c))
        self.data_min, self.data_max = self._aggregate(df, columns, lambda c: F.min(clean(c)), lambda c: F.max(clean(c)))
        self.range = [b - a for a, b in zip(self.data_min, self.data_max)]
        return self

    def _forward(self, i, x):
        if self.range[i] < FLOOR:
            return F.when(x.isNotNull(), self.low)
        return (x - F.lit(self.data_min[i])) / F.lit(self.range[i]) * F.lit(self.high - self.low) + F.lit(self.low)

    def _backward(self, i, x):
        if self.range[i] < FLOOR:
            return F.when(x.isNotNull(), self.data_min[i])
        return (x - F.lit(self.low)) / F.lit(self.high - self.low) * F.lit(self.range[i]) + F.lit(self.data_min[i])

    def scale(self):
        return self.range

    def offset(self):
        return self.data_min


class RobustScaler(Transformer):
    """(x - median) / interquartile range, both exact; a range under the floor counts as 1."""

    def fit(self, df, columns):
        q = self._quantiles(df, columns, [0.25, 0.5, 0.75])
        self.median = [x[1] for x in q]
        self.iqr = [1.0 if x[2] - x[0] < FLOOR else x[2] - x[0] for x in q]
        return self

    def _forward(self, i, x):
        return (x - F.lit(self.median[i])) / F.lit(self.iqr[i])

    def _backward(self, i, x):
        return x * F.lit(self.iqr[i]) + F.lit(self.median[i])

    def scale(self):
        return self.iqr

    def offset(self):
        return self.median


class Imputer(Transformer):
    """Fills nulls by mean, median, most frequent value or a constant."""

    def __init__(self, strategy: str = "mean", value: float = 0.0):
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise InvalidParameter(f"Unknown strategy '{strategy}'")
        self.strategy, self.value = strategy, value

    def fit(self, df, columns):
        if self.strategy == "median":
            self.fill = [q for (q,) in self._quantiles(df, columns, [0.5])]
            return self
        of = {
            "mean": lambda c: F.avg(col(c)),
            "most_frequent": lambda c: F.mode(col(c), True),
            "constant": lambda c: F.max(F.lit(float(self.value))),
        }[self.strategy]
        (self.fill,) = self._aggregate(df, columns, of)
        return self

    def _forward(self, i, x):
        return F.coalesce(x, F.lit(self.fill[i]))

    def _backward(self, i, x):
        return x


class LabelEncoder:
    """Codes 0, 1, ... of a column's sorted distinct values; the catalogue is a table, joined for either direction."""

    catalog: DataFrame | None = None

    def fit(self, df: DataFrame, column: str):
        self.column = column
        distinct = df.select(F.col(column).alias("category")).where("category IS NOT NULL").distinct()
        self.catalog = numbered(distinct, [F.col("category")], "code").withColumn("code", (F.col("code") - 1).cast("int"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.catalog.withColumnRenamed("category", self.column), self.column, "left")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.catalog, "code", "left")

    def one_hot(self, df: DataFrame, name: str = "features") -> DataFrame:
        """Adds an array with a place for each category, 1 at the row's own; null and unknown categories are all 0."""
        size = self.catalog.count()
        hot = F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda i: F.when(i == F.col("code"), 1.0).otherwise(0.0))
        return self.transform(df).withColumn(name, hot if size else F.expr("CAST(array() AS array<double>)")).drop("code")
