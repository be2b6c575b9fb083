"""What user code can extend: the engine's protocols."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame

from .operators.scaling import Transformer  # noqa: F401


@runtime_checkable
class Predictor(Protocol):
    """A fitted model that adds a column to a table."""

    def predict(self, df: DataFrame, name: str = ...) -> DataFrame: ...


@runtime_checkable
class SupervisedModel(Predictor, Protocol):
    def fit(self, df: DataFrame, features: list[str], target: str, *args, **kwargs): ...


@runtime_checkable
class Clusterer(Predictor, Protocol):
    def fit(self, packed: DataFrame, *args, **kwargs): ...

    def fit_predict(self, packed: DataFrame, *args, **kwargs) -> DataFrame: ...


@runtime_checkable
class UnsupervisedModel(Protocol):
    def fit(self, df: DataFrame, columns: list[str]): ...

    def transform(self, df: DataFrame) -> DataFrame: ...


class Metric(Protocol):
    """An aggregate column of truth and prediction."""

    def __call__(self, y, p) -> Column: ...
