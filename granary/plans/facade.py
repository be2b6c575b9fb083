"""One entry to every algorithm, by name and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.metrics import training_accuracy
from ..functions.validation import algorithm_input, defaults
from ..operators.scaling import MinMaxScaler, RobustScaler, StandardScaler
from .kmeans import KMeans
from .linear import LinearRegression
from .logistic import LogisticRegression
from .pca import PCA


@dataclass
class Outcome:
    algorithm: str
    model: object
    result: DataFrame
    metrics: dict[str, float]
    status: str = "Converged"


def run(algorithm: str, df: DataFrame, features: list[str], target: str | None = None, **parameters) -> Outcome:
    """Fit an algorithm and apply it to its own table; parameters default to the catalogue's."""
    p = (defaults(algorithm) if algorithm != "RobustScaler" else {}) | parameters
    algorithm_input(df.count(), len(features), p.get("n_clusters"), p.get("max_iterations"), p.get("learning_rate"))
    if algorithm == "KMeans":
        packed = df.withColumn("features", F.array(*[F.col(c).cast("double") for c in features]))
        m = KMeans(p["n_clusters"], p["max_iterations"], p["tolerance"], seed=42).fit(packed)
        return Outcome(algorithm, m, m.predict(packed), {"inertia": m.inertia, "iterations": m.n_iterations}, "Converged" if m.n_iterations < p["max_iterations"] else "MaxIterationsReached")
    if algorithm == "PCA":
        m = PCA(min(p["n_components"], len(features))).fit(df, features)
        return Outcome(algorithm, m, m.transform(df), {f"ratio_{i + 1}": float(r) for i, r in enumerate(m.explained_variance_ratio())})
    if algorithm == "LinearRegression":
        m = LinearRegression(p["learning_rate"]).fit(df, features, target, p["max_iterations"])
        return Outcome(algorithm, m, m.predict(df), {"cost": m.history[-1]}, "MaxIterationsReached")
    if algorithm == "LogisticRegression":
        m = LogisticRegression(p["learning_rate"], p["max_iterations"]).fit(df, features, target)
        out = m.predict(df)
        codes = F.array_position(F.array(*[F.lit(float(x)) for x in m.labels]), F.col(target).cast("double")) - 1
        return Outcome(algorithm, m, out, {"accuracy": out.agg(training_accuracy(codes, "prediction")).first()[0], "iterations": m.n_iterations}, "Converged" if m.n_iterations < p["max_iterations"] else "MaxIterationsReached")
    scalers = {"StandardScaler": StandardScaler, "MinMaxScaler": MinMaxScaler, "RobustScaler": RobustScaler}
    if algorithm not in scalers:
        raise InvalidParameter(f"Unknown algorithm '{algorithm}'")
    m = scalers[algorithm]().fit(df, features)
    return Outcome(algorithm, m, m.transform(df), {})


def fit_from_file(spark, path: str, target: str, iterations: int = 1000, learning_rate: float = 0.01) -> LinearRegression:
    """Load a strict CSV file and fit a linear regression to it."""
    from ..sources.csv import load_csv

    data = load_csv(spark, path, target)
    return LinearRegression(learning_rate).fit(data.df, data.feature_names, target, iterations)
