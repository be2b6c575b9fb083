"""Density clustering (DBSCAN) over a grid, exact, without a task that holds a dense place.

Cells are so small (eps / sqrt(dimensions) wide) that all points of a cell are neighbours: a cell of ``min_points`` has
only core points, whatever its size, and core points of a cell share a cluster.  What is left are comparisons between
cells near each other.  Where a side has more than LIMIT points it is cut in halves along each axis, and halves that are
too far apart are dropped, or (both sides being core) two that are near throughout settle the pair; so a task compares at
most LIMIT points with LIMIT others, and crowded cells cost no more than what lies along their borders.  Points of equal
coordinates are one point that counts for many.  Cells that are linked make clusters by connected components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidParameter
from ..lineage import materialise
from ..operators.components import connected_components

#: Points of one side that are compared with another side's at once.
LIMIT = 256
#: Beyond so many dimensions a cell has thousands of neighbours; project first.
MOST_DIMENSIONS = 4
#: Relative allowance for rounding in distances between boxes; points are always compared exactly.
ROUNDING = 1e-6


def usable(packed: DataFrame, row_id: str, features: str) -> tuple[DataFrame, DataFrame, int]:
    """``row_id, x`` of all rows and of those whose coordinates are all there and finite, and the number of dimensions."""
    x = F.transform(F.col(features).cast("array<double>"), lambda v: v + F.lit(0.0))  # one zero, not two
    rows = packed.select(F.col(row_id).cast("long").alias("row_id"), x.alias("x"))
    fit = F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size("x") > 0), F.lit(False))
    good = rows.where(fit & F.col("row_id").isNotNull())
    low, high = good.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise DimensionMismatch("Vectors must have the same length")
    if (low or 0) > MOST_DIMENSIONS:
        raise InvalidParameter(f"At most {MOST_DIMENSIONS} dimensions, not {low}")
    return rows, good, low or 1


def gridded(points: DataFrame, width: float, dims: int) -> DataFrame:
    """Adds ``t``, the coordinates from the least ones on in cell widths."""
    least = points.agg(*[F.min(F.col("x")[j]) for j in range(dims)]).first()
    origin = F.array(*[F.lit(float(v or 0.0)) for v in least])
    return points.withColumn("t", F.zip_with("x", origin, lambda v, o: (v - o) / F.lit(width)))


def box(level: int) -> Column:
    """A point's box after cells have been halved ``level`` times."""
    return F.transform("t", lambda v: F.floor(v * F.lit(float(1 << level))))


def shifts(dims: int, reach: float, half: bool = False) -> Column:
    """Offsets of cells with points within ``reach`` cell widths; half of them: one of each opposite two, without zero."""
    far = int(reach) + 1
    every = [o for o in product(range(-far, far + 1), repeat=dims) if sum(max(0, abs(k) - 1) ** 2 for k in o) <= reach * reach * (1 + ROUNDING)]
    return F.array(*[F.array(*[F.lit(k).cast("long") for k in o]) for o in every if not half or o > (0,) * dims])


def squared(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _sum_of_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, g: s + g * g)


def _moved(cell: str, shift: str) -> Column:
    return F.zip_with(cell, shift, lambda c, k: c + k)


def _arrays(points: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """``b, m``: the points of each box; and ``b, pts`` of the boxes that have LIMIT of them at most."""
    boxed = points.withColumn("b", box(level))
    sizes = materialise(boxed.groupBy("b").agg(F.count(F.lit(1)).alias("m")))
    few = boxed.join(sizes.where(F.col("m") <= LIMIT).select("b"), "b").groupBy("b").agg(F.collect_list(F.struct("pid", "x", "n")).alias("pts"))
    return sizes, few


@dataclass
class Density:
    """Points with ``min_points`` points (themselves among them) within ``eps`` are core; core points within eps of each
    other share a cluster; a point that isn't core but within eps of one is a border point of the cluster, of several
    the one of smallest number; all others are noise."""

    eps: float
    min_points: int

    def __post_init__(self):
        if not (self.eps > 0 and math.isfinite(self.eps)) or self.min_points < 1:
            raise InvalidParameter("eps must be positive and finite, min_points 1 or more")

    def _near(self, pairs: DataFrame, points: DataFrame, reach2: float) -> DataFrame:
        """``a, cell, pts``: for pairs ``a, cell`` of cells, the points of ``cell`` in arrays of at most LIMIT, of boxes
        that may lie within eps of cell ``a``."""
        out, level, pairs = None, 0, pairs.withColumn("b", F.col("cell"))
        while True:
            sizes, few = _arrays(points, level)
            met = materialise(pairs.join(sizes, "b"))
            found = met.where(F.col("m") <= LIMIT).join(few, "b").select("a", "cell", "pts")
            out = found if out is None else out.unionByName(found)
            large = met.where(F.col("m") > LIMIT).select("a", "cell", "b")
            if large.isEmpty():
                return out
            halves = points.select(box(level).alias("b"), box(level + 1).alias("half")).distinct()
            level += 1
            side = 1 << level
            gap = F.zip_with("a", "half", lambda a, h: F.greatest(F.lit(0), h - (a + 1) * side, a * side - h - 1).cast("double"))
            near = _sum_of_squares(gap) <= reach2 * 4.0**level * (1 + ROUNDING)
            pairs = materialise(large.join(halves, "b").where(near).select("a", "cell", F.col("half").alias("b")))

    def _linked(self, pairs: DataFrame, points: DataFrame, reach2: float) -> DataFrame:
        """Those pairs ``p, q`` of cells that have points within eps of each other."""
        out, level, pairs = None, 0, pairs.select("p", "q", F.col("p").alias("a"), F.col("q").alias("b"))
        while True:
            sizes, few = _arrays(points, level)
            one, two = (sizes.toDF(x, f"m{x}") for x in "ab")
            met = pairs.join(one, "a").join(two, "b")
            across = _sum_of_squares(F.zip_with("a", "b", lambda a, b: (F.abs(a - b) + 1).cast("double")))
            met = materialise(met.withColumn("whole", across <= reach2 * 4.0**level * (1 - ROUNDING)))
            small = met.where(~F.col("whole") & (F.col("ma") <= LIMIT) & (F.col("mb") <= LIMIT))
            one, two = (few.toDF(x, f"pts{x}") for x in "ab")
            touch = F.exists("ptsa", lambda x: F.exists("ptsb", lambda y: squared(x["x"], y["x"]) <= F.lit(self.eps * self.eps)))
            found = small.join(one, "a").join(two, "b").where(touch).select("p", "q")
            found = materialise(met.where("whole").select("p", "q").unionByName(found).distinct())
            out = found if out is None else out.unionByName(found)
            large = met.where(~F.col("whole") & ((F.col("ma") > LIMIT) | (F.col("mb") > LIMIT))).select("p", "q", "a", "b").join(found, ["p", "q"], "left_anti")
            if large.isEmpty():
                return out.distinct()
            halves = points.select(box(level).alias("b"), box(level + 1).alias("half")).distinct()
            level += 1
            one, two = halves.toDF("a", "ha"), halves.toDF("b", "hb")
            gap = F.zip_with("ha", "hb", lambda a, b: F.greatest(F.lit(0), F.abs(a - b) - 1).cast("double"))
            near = _sum_of_squares(gap) <= reach2 * 4.0**level * (1 + ROUNDING)
            pairs = materialise(large.join(one, "a").join(two, "b").where(near).select("p", "q", F.col("ha").alias("a"), F.col("hb").alias("b")))

    def fit_predict(self, packed: DataFrame, row_id: str = "row_id", features: str = "features") -> DataFrame:
        """``row_id, cluster, kind`` of each row: cluster is the smallest row_id of its core points, -1 for noise; kind
        is core, border or noise.

        Rows without a row_id, or whose vector is null or empty or holds a null, NaN or infinity, are noise and nobody's
        neighbours.  Rows that repeat a vector count one by one; vectors of several lengths, or of over MOST_DIMENSIONS
        numbers, are an error; an empty table gives no rows.
        """
        rows, good, dims = usable(packed, row_id, features)
        width = self.eps / math.sqrt(dims) * (1 - 1e-9)
        reach = self.eps / width
        points = materialise(good.groupBy("x").agg(F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("n")))
        points = materialise(gridded(points, width, dims).withColumn("cell", box(0)))
        total = materialise(points.groupBy("cell").agg(F.sum("n").alias("total")))
        sparse = points.join(total.where(F.col("total") < self.min_points).select("cell"), "cell")
        dense = points.join(total.where(F.col("total") >= self.min_points).select("cell"), "cell").select("pid", "x", "n", "t", "cell")

        def around(cells: DataFrame, others: DataFrame) -> DataFrame:
            pairs = cells.select(F.col("cell").alias("a"), F.explode(shifts(dims, reach)).alias("o")).select("a", _moved("a", "o").alias("cell"))
            return pairs.join(others.select("cell").distinct(), "cell")

        def within(groups: DataFrame, others: DataFrame) -> DataFrame:
            """``pid, cell, n``: how many of the others in a cell are within eps of each point of the groups."""
            near = self._near(around(groups, others), others, reach * reach).join(groups.withColumnRenamed("cell", "a").withColumnRenamed("pts", "own"), "a")
            count = lambda p: F.aggregate("pts", F.lit(0).cast("long"), lambda s, y: s + F.when(squared(p["x"], y["x"]) <= F.lit(self.eps * self.eps), y["n"]).otherwise(F.lit(0)))
            counted = near.select("cell", F.explode(F.transform("own", lambda p: F.struct(p["pid"].alias("pid"), count(p).alias("n")))).alias("c"))
            return counted.select("c.pid", "cell", "c.n").where("n > 0")

        # groups of fewer than min_points
        groups = materialise(sparse.groupBy("cell").agg(F.collect_list(F.struct("pid", "x")).alias("pts")))
        crowded = within(groups, points).groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_points).select("pid")
        core = materialise(sparse.join(crowded, "pid").select("pid", "x", "n", "t", "cell").unionByName(dense))
        heads = materialise(core.groupBy("cell").agg(F.min("pid").alias("head")))
        pairs = heads.select(F.col("cell").alias("p"), F.explode(shifts(dims, reach, True)).alias("o")).select("p", _moved("p", "o").alias("cell"))
        pairs = pairs.join(heads.select("cell"), "cell").withColumnRenamed("cell", "q")
        linked = self._linked(pairs, core, reach * reach)
        links = linked.join(heads.toDF("p", "u"), "p").join(heads.toDF("q", "v"), "q").select("u", "v")
        roots = materialise(connected_components(links))
        clusters = materialise(heads.join(roots, F.col("head") == F.col("node"), "left").select("cell", F.coalesce("root", "head").alias("cluster")))
        loose = sparse.join(core.select("pid"), "pid", "left_anti").groupBy("cell").agg(F.collect_list(F.struct("pid", "x")).alias("pts"))
        border = within(materialise(loose), core).join(clusters, "cell").groupBy("pid").agg(F.min("cluster").alias("cluster"))
        told = core.join(clusters, "cell").select("pid", "cluster", F.lit("core").alias("kind")).unionByName(border.select("pid", "cluster", F.lit("border").alias("kind")))
        told = points.select("x", "pid").join(told, "pid").select("x", "cluster", "kind")
        out = rows.join(told.withColumnRenamed("x", "at"), (F.col("x") == F.col("at")) & F.col("row_id").isNotNull(), "left")
        return out.select("row_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), F.coalesce("kind", F.lit("noise")).alias("kind"))
