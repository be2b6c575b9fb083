"""Activations, their derivatives and initialisers, for columns and for NumPy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter

NAMES = ("sigmoid", "relu", "tanh", "linear")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def activate(name: str, z: Column) -> Column:
    if name == "sigmoid":
        return sigmoid(z)
    if name == "relu":
        return F.when(F.isnan(z), 0.0).otherwise(F.greatest(z, F.lit(0.0)))
    if name == "tanh":
        return F.tanh(z)
    if name == "linear":
        return z
    raise InvalidParameter(f"Unknown activation '{name}'")


def derivative(name: str, z: Column) -> Column:
    """Derivative at the pre-activation z."""
    if name == "sigmoid":
        return sigmoid(z) * (1 - sigmoid(z))
    if name == "relu":
        return F.when(z > 0, 1.0).otherwise(0.0)
    if name == "tanh":
        return 1 - F.tanh(z) * F.tanh(z)
    if name == "linear":
        return F.lit(1.0)
    raise InvalidParameter(f"Unknown activation '{name}'")


def np_activate(name: str, z: np.ndarray) -> np.ndarray:
    return {"sigmoid": lambda: 1 / (1 + np.exp(-z)), "relu": lambda: np.fmax(z, 0.0), "tanh": lambda: np.tanh(z), "linear": lambda: z}[name]()


def np_derivative(name: str, z: np.ndarray) -> np.ndarray:
    s = np_activate(name, z)
    return {"sigmoid": lambda: s * (1 - s), "relu": lambda: (z > 0).astype(float), "tanh": lambda: 1 - s * s, "linear": lambda: np.ones_like(z)}[name]()


def initialize(kind: str, fan_in: int, fan_out: int, rng: np.random.Generator) -> np.ndarray:
    """Weights, fan_out by fan_in, uniform within the scheme's bound."""
    bounds = {"xavier": np.sqrt(6 / (fan_in + fan_out)), "he": np.sqrt(3) * np.sqrt(2 / fan_in), "zeros": 0.0, "small_random": 0.01}
    if kind not in bounds:
        raise InvalidParameter(f"Unknown initializer '{kind}'")
    return rng.uniform(-1, 1, (fan_out, fan_in)) * bounds[kind]
