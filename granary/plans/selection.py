"""Splits, cross-validation and regularised linear models.

Everything is solved from moments: one aggregate gives each fold's moments, whose differences are the training sets', so
that trying any number of penalties over k folds costs one Spark job in all.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyData, InvalidParameter
from ..operators.stats import Moments, _products, col, complete
from ..streaming.incremental import merge
from .linear import LinearRegression, _system


def fold(key: Column, k: int, seed: int = 0) -> Column:
    """A row's fold, 0 to k - 1, by a hash of its key: the same in any partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int")


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    if not 0 < test_share < 1:
        raise InvalidParameter("test_share must be between 0 and 1")
    is_test = fold(F.col(key), 1_000_000, seed) < int(test_share * 1_000_000)
    return df.where(~is_test), df.where(is_test)


def fold_moments(df: DataFrame, columns: list[str], by: Column, k: int) -> list[Moments]:
    """Moments of each fold's complete rows, from one grouped aggregate."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    rows = (
        complete(df, columns)
        .groupBy(by.alias("_fold"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.covar_pop(col(columns[i]), col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    out = [Moments(tuple(columns), 0, np.zeros(len(columns)), np.zeros((len(columns),) * 2)) for _ in range(k)]
    for r in rows:
        out[r["_fold"]] = Moments(tuple(columns), r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(len(columns))]), _products(r, pairs, len(columns)))
    return out


def _merged(parts: list[Moments]) -> Moments:
    out = None
    for p in parts:
        out = merge(out, p)
    return out


def ridge(m: Moments, penalty: float) -> tuple[np.ndarray, float]:
    """Minimiser of the mean squared error plus penalty |w|^2; the bias is free.  The target is the last column."""
    p = len(m.columns) - 1
    cov = m.products / m.n
    w = np.linalg.solve(cov[:p, :p] + penalty * np.eye(p), cov[:p, p])
    return w, float(m.means[p] - w @ m.means[:p])


def lasso(m: Moments, penalty: float, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Minimiser of half the mean squared error plus penalty |w|_1, by coordinate descent on the moments."""
    p = len(m.columns) - 1
    cov, w = m.products / m.n, np.zeros(p)
    for _ in range(rounds):
        old = w.copy()
        for j in range(p):
            rho = cov[j, p] - cov[j, :p] @ w + cov[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - penalty, 0.0) / cov[j, j] if cov[j, j] > 0 else 0.0
        if np.abs(w - old).max(initial=0.0) < tolerance:
            break
    return w, float(m.means[p] - w @ m.means[:p])


SOLVERS = {"ridge": ridge, "lasso": lasso}


def mean_squared_error(m: Moments, w: np.ndarray, b: float) -> float:
    g, h, q = _system(m)
    theta = np.append(w, b)
    return max(float(theta @ g @ theta - 2 * theta @ h + q), 0.0)


@dataclass
class Search:
    """Penalties with their cross-validated errors, and the model of the best one fitted to all rows."""

    table: list[tuple[float, float]] = field(default_factory=list)
    best: float = 0.0
    model: LinearRegression | None = None


def cross_validate(df: DataFrame, features: list[str], target: str, key: str, penalties: list[float], k: int = 5, kind: str = "ridge", seed: int = 0) -> Search:
    if kind not in SOLVERS or k < 2:
        raise InvalidParameter("kind must be ridge or lasso, and k 2 at least")
    parts = fold_moments(df, [*features, target], fold(F.col(key), k, seed), k)
    used = [i for i, p in enumerate(parts) if p.n]
    if len(used) < 2:
        raise EmptyData("Cannot cross-validate on fewer than two folds with rows")
    out = Search()
    for penalty in penalties:
        errors = [mean_squared_error(parts[i], *SOLVERS[kind](_merged([p for j, p in enumerate(parts) if j != i]), penalty)) for i in used]
        out.table.append((penalty, float(np.average(errors, weights=[parts[i].n for i in used]))))
    out.best = min(out.table, key=lambda x: (x[1], x[0]))[0]
    w, b = SOLVERS[kind](_merged(parts), out.best)
    out.model = LinearRegression(features=list(features), weights=w, bias=b)
    return out


def mape(y, p) -> Column:
    """Mean absolute percentage error over the rows whose truth isn't zero."""
    return F.avg(F.when(col(y) != 0, F.abs((col(y) - col(p)) / col(y)))) * 100


def polynomial(df: DataFrame, columns: list[str], degree: int) -> tuple[DataFrame, list[str]]:
    """Powers and products of columns up to a degree, as new columns, and their names."""
    terms = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            e = col(combo[0])
            for c in combo[1:]:
                e = e * col(c)
            terms["*".join(combo)] = e
    return df.withColumns(terms), [*columns, *terms]
