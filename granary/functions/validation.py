"""Validation of parameters as column expressions, default parameters, catalogues and progress."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..operators.table import number


def _state(kind: str, message) -> Column:
    return F.struct(F.lit(kind).alias("state"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


_VALID = ("Valid", None)


def _none() -> Column:
    return F.struct(F.lit("Valid").alias("state"), F.lit(None).cast("string").alias("message"))


def positive_number(c: Column) -> Column:
    x = number(F.trim(c))
    return F.when(x.isNull() | F.isnan(x), _state("Invalid", "Must be a number")).when(x <= 0, _state("Invalid", "Must be positive")).otherwise(_none())


def learning_rate(c: Column) -> Column:
    x = number(F.trim(c))
    return (
        F.when(x.isNull() | F.isnan(x), _state("Invalid", "Must be a number"))
        .when(x <= 0, _state("Invalid", "Must be positive"))
        .when(x > 10, _state("Warning", "Very large: training may diverge"))
        .when(x < 1e-4, _state("Warning", "Very small: training will be slow"))
        .otherwise(_none())
    )


def _integer(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\+?\d+$"), F.trim(c).try_cast("long"))


def integer_in_range(c: Column, low: int, high: int) -> Column:
    x = _integer(c)
    return F.when(x.isNull(), _state("Invalid", "Must be a whole number")).when((x < low) | (x > high), _state("Invalid", f"Must be between {low} and {high}")).otherwise(_none())


def k_clusters(c: Column, n: Column) -> Column:
    x = _integer(c)
    return (
        F.when(x.isNull(), _state("Invalid", "Must be a whole number"))
        .when(x < 1, _state("Invalid", "Must be at least 1"))
        .when(x > n, _state("Invalid", "Cannot exceed the number of samples"))
        .when(x == 1, _state("Warning", "One cluster holds everything"))
        .when(x > F.floor(n / 2), _state("Warning", "Many clusters for so few samples"))
        .otherwise(_none())
    )


def max_iterations(c: Column) -> Column:
    x = _integer(c)
    return F.when(x.isNull(), _state("Invalid", "Must be a whole number")).when(x < 1, _state("Invalid", "Must be at least 1")).when(x > 100_000, _state("Warning", "May take long")).otherwise(_none())


def is_valid(state: Column) -> Column:
    """Warnings count as valid."""
    return state["state"] != "Invalid"


def csv_file_size(size: int, limit: int = 5 << 20, warn: int = 2 << 20) -> tuple[str, str | None]:
    return ("Invalid", f"File is larger than {limit >> 20} MiB") if size > limit else ("Warning", "Large file") if size > warn else _VALID


def csv_dimensions(rows: int, cols: int) -> tuple[str, str | None]:
    if rows > 10_000 or cols > 100:
        return "Invalid", "At most 10000 rows and 100 columns"
    if rows == 0 or cols == 0:
        return "Invalid", "Empty table"
    return ("Warning", "Large table") if rows > 5_000 or cols > 50 else ("Warning", "Few rows") if rows < 10 else _VALID


def algorithm_input(rows: int, cols: int, k: int | None = None, iterations: int | None = None, rate: float | None = None) -> None:
    if not rows or not cols:
        raise InvalidParameter("Input matrix is empty")
    if k is not None and not 0 < k <= rows:
        raise InvalidParameter(f"k must be between 1 and {rows}")
    if iterations is not None and not 0 < iterations <= 100_000:
        raise InvalidParameter("Iterations must be between 1 and 100000")
    if rate is not None and not 0 < rate <= 10:
        raise InvalidParameter("Learning rate must be between 0 and 10")


def guarded(f, *args, **kwargs) -> tuple[object, str | None]:
    """(result, None), or (None, message) if it raised."""
    try:
        return f(*args, **kwargs), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


@dataclass(frozen=True)
class Parameter:
    """A number with bounds and a threshold above which to warn."""

    name: str
    default: float
    low: float | None = None
    high: float | None = None
    warn: float | None = None
    whole: bool = False

    def validate(self, x: float) -> tuple[str, str | None]:
        if self.low is not None and x < self.low:
            return "Invalid", f"{self.name} must be at least {self.low}"
        if self.high is not None and x > self.high:
            return "Invalid", f"{self.name} must be at most {self.high}"
        return ("Warning", f"{self.name} is large") if self.warn is not None and x > self.warn else _VALID

    def convert(self, x) -> float | int:
        return int(float(x)) if self.whole else float(x)


# Default parameters, presets and catalogue.
PARAMETERS = {
    "KMeans": (Parameter("n_clusters", 3, 2, 20, whole=True), Parameter("max_iterations", 100, 1, 1000, whole=True), Parameter("tolerance", 1e-4)),
    "PCA": (Parameter("n_components", 2, 1, 50, whole=True),),
    "LogisticRegression": (Parameter("learning_rate", 0.01, 1e-5, 1.0), Parameter("max_iterations", 1000, 10, 10_000, whole=True)),
    "LinearRegression": (Parameter("learning_rate", 0.01, 1e-5, 1.0), Parameter("max_iterations", 1000, 10, 10_000, whole=True)),
    "StandardScaler": (),
    "MinMaxScaler": (),
}
PRESETS = {
    "conservative": {"learning_rate": 0.001, "max_iterations": 500, "n_clusters": 2},
    "balanced": {},
    "aggressive": {"learning_rate": 0.1, "max_iterations": 2000, "n_clusters": 8},
}
ALGORITHMS = (
    ("KMeans", "Clustering", "Groups rows around k centroids"),
    ("PCA", "DimensionalityReduction", "Projects onto directions of largest variance"),
    ("LogisticRegression", "Classification", "Linear classifier with probabilities"),
    ("LinearRegression", "Regression", "Fits a line by gradient descent"),
    ("StandardScaler", "Preprocessing", "Zero mean and unit variance"),
    ("MinMaxScaler", "Preprocessing", "Scales to a range"),
)


def defaults(algorithm: str, preset: str = "balanced") -> dict[str, float]:
    """Default parameters under a preset, held within their bounds."""
    out = {}
    for p in PARAMETERS[algorithm]:
        x = PRESETS[preset].get(p.name, p.default)
        out[p.name] = p.convert(min(max(x, p.low if p.low is not None else x), p.high if p.high is not None else x))
    return out


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALGORITHMS), "name string, category string, description string")


def parameter_table(spark: SparkSession) -> DataFrame:
    rows = [(a, p.name, float(p.default), None if p.low is None else float(p.low), None if p.high is None else float(p.high)) for a, ps in PARAMETERS.items() for p in ps]
    return spark.createDataFrame(rows, "algorithm string, parameter string, default_value double, low double, high double")


STATUSES = ("NotStarted", "Running", "Converged", "MaxIterationsReached", "Diverged", "Failed")


def progress(iteration: Column, total: Column, first: Column, last: Column, elapsed_ms: Column) -> Column:
    """struct of ``progress_pct, improvement_pct, eta_ms``."""
    return F.struct(
        F.coalesce(F.try_divide(iteration * 100.0, total), F.lit(0.0)).alias("progress_pct"),
        F.coalesce(F.try_divide((first - last) * 100.0, first), F.lit(0.0)).alias("improvement_pct"),
        F.when((iteration > 0) & (iteration < total), elapsed_ms / iteration * (total - iteration)).alias("eta_ms"),
    )


def format_time(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.format_string("%.0fms", ms.cast("double")))
        .when(s < 60, F.format_string("%.1fs", (ms / 1000).cast("double")))
        .otherwise(F.format_string("%dm %ds", F.floor(s / 60), s % 60))
    )
