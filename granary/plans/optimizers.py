"""Gradient-descent optimizers: as folds over a sequence (a row of a table is a run), and for NumPy parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import InvalidParameter
from ..functions.binding import let
from ..functions.surfaces import NAMES, SURFACES, chosen, gradient, value

KINDS = ("SGD", "Momentum", "RMSprop", "Adam")
#: beta1, beta2, epsilon of each kind.
DEFAULTS = {"SGD": (0.0, 0.0, 1e-8), "Momentum": (0.9, 0.0, 1e-8), "RMSprop": (0.0, 0.999, 1e-8), "Adam": (0.9, 0.999, 1e-8)}
MAX_ITERATIONS, CONVERGED = 10_000, 1e-6


@dataclass
class Optimizer:
    """Steps of parameters of any shape, told apart by a key; state starts at zeros."""

    kind: str
    learning_rate: float
    beta1: float | None = None
    beta2: float | None = None
    epsilon: float = 1e-8
    #: count a time step for each call that updates weights, rather than one for all layers of an iteration
    legacy_timestep: bool = False
    t: int = 0
    state: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise InvalidParameter(f"Unknown optimizer '{self.kind}'")
        b1, b2, _ = DEFAULTS[self.kind]
        self.beta1 = b1 if self.beta1 is None else self.beta1
        self.beta2 = b2 if self.beta2 is None else self.beta2
        if not (self.learning_rate > 0 and np.isfinite(self.learning_rate)):
            raise InvalidParameter("Learning rate must be positive and finite")
        if not (0 <= self.beta1 < 1 and 0 <= self.beta2 < 1):
            raise InvalidParameter("Betas must be in [0, 1)")
        if self.epsilon < 1e-15:
            raise InvalidParameter("Epsilon must be at least 1e-15")

    def tick(self) -> None:
        """Begin an iteration."""
        if not self.legacy_timestep:
            self.t += 1

    def update(self, key, parameter, g, weights: bool = True):
        """The parameter after one step along gradient g."""
        g = np.asarray(g, dtype=float)
        if self.legacy_timestep and weights:
            self.t += 1
        m, v = self.state.get(key, (np.zeros_like(g), np.zeros_like(g)))
        if self.kind == "SGD":
            return parameter - self.learning_rate * g
        if self.kind == "Momentum":
            m = self.beta1 * m + g
            step = m
        elif self.kind == "RMSprop":
            v = self.beta2 * v + (1 - self.beta2) * g * g
            step = g / np.sqrt(v + self.epsilon)
        else:
            t = max(self.t, 1)
            m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
            step = m / max(1 - self.beta1**t, 1e-8) / (np.sqrt(v / max(1 - self.beta2**t, 1e-8)) + self.epsilon)
        self.state[key] = m, v
        return parameter - self.learning_rate * step

    def step_2d(self, x: float, y: float, gx: float, gy: float) -> tuple[float, float]:
        self.tick()
        if self.legacy_timestep:
            self.t += 1
        return float(self.update("x", x, gx, False)), float(self.update("y", y, gy, False))

    def reset(self) -> None:
        self.t, self.state = 0, {}


def runs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of runs: ``racer, optimizer, surface, lr, beta1, beta2, epsilon, x, y`` from (optimizer, surface, lr[, beta1, beta2])."""
    out = []
    for i, (kind, surface, lr, *betas) in enumerate(rows):
        b1, b2, eps = DEFAULTS[kind]
        b1, b2 = (*betas, *(b1, b2)[len(betas) :])
        start = next(s[4] for s in SURFACES if s[0] == surface)
        out.append((i, kind, surface, float(lr), b1, b2, eps, *start))
    return spark.createDataFrame(out, "racer int, optimizer string, surface string, lr double, beta1 double, beta2 double, epsilon double, x double, y double")


def race(spark: SparkSession, surface: str, lr: float) -> DataFrame:
    """Four optimizers from the surface's start, with one learning rate."""
    return runs(spark, [("SGD", surface, lr), ("Momentum", surface, lr, 0.9), ("RMSprop", surface, lr, 0.0, 0.9), ("Adam", surface, lr, 0.9, 0.999)])


def demo(spark: SparkSession, surface: str) -> DataFrame:
    return runs(spark, [("SGD", surface, 0.001), ("Momentum", surface, 0.001), ("RMSprop", surface, 0.01, 0.0, 0.999), ("Adam", surface, 0.01)])


_STATE = ("x", "y", "mx", "my", "vx", "vy", "t", "loss", "converged", "slope")


def _start() -> Column:
    p, zero = F.col, F.lit(0.0)
    loss = chosen(p("surface"), lambda k: value(k, p("x"), p("y")))
    parts = (p("x"), p("y"), zero, zero, zero, zero, F.lit(0), loss, F.lit(False), F.lit(float("inf")))
    return F.struct(*[c.alias(f) for c, f in zip(parts, _STATE)])


def _step(s: Column) -> Column:
    """State after one step.  Each part is bound before it is used again, so that the expression stays small."""
    p = F.col
    kind, lr, b1, b2, eps = p("optimizer"), p("lr"), p("beta1"), p("beta2"), p("epsilon")

    def slopes() -> Column:
        out = F.lit(None)
        for n in NAMES:
            gx, gy = gradient(n, s["x"], s["y"])
            out = F.when(p("surface") == n, F.struct(gx.alias("x"), gy.alias("y"))).otherwise(out)
        return out

    def moments(g: Column) -> Column:
        parts = []
        for axis in "xy":
            m, v, d = s[f"m{axis}"], s[f"v{axis}"], g[axis]
            parts.append(F.when(kind == "Momentum", b1 * m + d).when(kind == "Adam", b1 * m + (1 - b1) * d).otherwise(m).alias(f"m{axis}"))
            parts.append(F.when(kind.isin("RMSprop", "Adam"), b2 * v + (1 - b2) * d * d).otherwise(v).alias(f"v{axis}"))
        t = s["t"] + 1
        return F.struct(*parts, F.greatest(1 - F.pow(b1, t), F.lit(1e-8)).alias("c1"), F.greatest(1 - F.pow(b2, t), F.lit(1e-8)).alias("c2"))

    def place(g: Column, n: Column) -> Column:
        def at(axis):
            m, v, d = n[f"m{axis}"], n[f"v{axis}"], g[axis]
            move = F.when(kind == "SGD", d).when(kind == "Momentum", m).when(kind == "RMSprop", d / F.sqrt(v + eps)).otherwise(m / n["c1"] / (F.sqrt(v / n["c2"]) + eps))
            return (s[axis] - lr * move).alias(axis)

        return F.struct(at("x"), at("y"))

    def state(g: Column, n: Column, q: Column) -> Column:
        loss = chosen(p("surface"), lambda k: value(k, q["x"], q["y"]))
        return let(loss, lambda f: F.struct(*[c.alias(k) for c, k in zip((q["x"], q["y"], n["mx"], n["my"], n["vx"], n["vy"], s["t"] + 1, f, f < CONVERGED, F.hypot(g["x"], g["y"])), _STATE)]))

    return let(slopes(), lambda g: let(moments(g), lambda n: let(place(g, n), lambda q: state(g, n, q))))


def trajectories(table: DataFrame, iterations: int, every: int = 1, rule: str = "loss") -> DataFrame:
    """``racer, optimizer, surface, iter, x, y, loss, converged`` of each run, from iteration 1 on.

    A run stops when its loss falls below 1e-6 (rule "loss") or the gradient before a step does (rule "gradient"), and
    after MAX_ITERATIONS.  All steps of a run are one fold over a sequence; runs are rows and go in parallel.
    """
    if iterations < 1:
        raise InvalidParameter("At least one iteration")

    def step(path: Column, i: Column) -> Column:
        def grown(s: Column) -> Column:
            new = lambda: F.concat(path, F.array(_step(s)))
            if rule == "gradient":  # a step that began on flat ground is not taken
                return F.when(s["converged"], path).otherwise(
                    let(_step(s), lambda n: F.when(n["slope"] < CONVERGED, F.concat(path, F.array(s.withField("converged", F.lit(True))))).otherwise(F.concat(path, F.array(n.withField("converged", F.lit(False))))))
                )
            return F.when(s["converged"], path).otherwise(new())

        return let(F.element_at(path, -1), grown)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(min(iterations, MAX_ITERATIONS))), F.array(_start()), step)
    out = table.withColumn("path", path).select("racer", "optimizer", "surface", F.posexplode("path").alias("iter", "s"))
    out = out.where((F.col("iter") > 0) & (F.col("iter") % every == 0))
    return out.select("racer", "optimizer", "surface", "iter", "s.x", "s.y", "s.loss", "s.converged")


def finals(table: DataFrame, iterations: int) -> DataFrame:
    """The state of each run after so many iterations (or where it converged), folded without keeping the path."""
    steps = F.sequence(F.lit(1), F.lit(min(iterations, MAX_ITERATIONS)))
    s = F.aggregate(steps, _start(), lambda s, i: F.when(s["converged"], s).otherwise(_step(s)))
    out = table.withColumn("first", chosen(F.col("surface"), lambda k: value(k, F.col("x"), F.col("y")))).withColumn("s", s)
    reduction = F.when(F.col("first") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("first") - F.col("s.loss")) / F.nullif(F.col("first"), F.lit(0.0)) * 100)))
    return out.select("racer", "optimizer", "surface", F.col("s.t").alias("iter"), "s.x", "s.y", "s.loss", "s.converged", reduction.alias("reduction_pct"))


def ranking(final: DataFrame) -> DataFrame:
    """Ranks 1 to n by loss, then by place in the list."""
    return final.withColumn("rank", F.row_number().over(W.partitionBy("surface").orderBy(F.col("loss").asc_nulls_last(), "racer")))


def winner(final: DataFrame) -> DataFrame:
    """``surface, winner, has_winner, finished``: the first that converged, else the one of least loss."""
    return final.groupBy("surface").agg(
        F.coalesce(F.min_by(F.when(F.col("converged"), F.col("optimizer")), F.when(F.col("converged"), F.col("racer"))), F.min_by("optimizer", F.struct("loss", "racer"))).alias("winner"),
        F.bool_or("converged").alias("has_winner"),
        F.bool_and(F.col("converged") | (F.col("iter") >= MAX_ITERATIONS)).alias("finished"),
    )


def distance_to_minimum(final: DataFrame) -> DataFrame:
    """Distance from the surface's first minimum."""
    at = lambda axis: chosen(F.col("surface"), lambda k: F.lit(next(s[5][0][axis] for s in SURFACES if s[0] == k)))
    return final.withColumn("distance", F.hypot(F.col("x") - at(0), F.col("y") - at(1)))
