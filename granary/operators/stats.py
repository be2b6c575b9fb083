"""Descriptive statistics, each one aggregate over the table.

``moments`` is what linear fits, correlations, standardisation and principal components share: one pass for any
number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import materialise

FLOOR = 1e-10
#: Columns up to which moments are taken by covariance expressions.
WIDE = 16


def col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def mean(c) -> Column:
    """Mean; 0 over no rows."""
    return F.coalesce(F.avg(col(c)), F.lit(0.0))


def variance(c) -> Column:
    """Sample variance; 0 under two rows."""
    return F.coalesce(F.var_samp(col(c)), F.lit(0.0))


def std_dev(c) -> Column:
    return F.coalesce(F.stddev_samp(col(c)), F.lit(0.0))


def pearson(a, b) -> Column:
    """Pearson's r over the rows that have both values; 0 under two of them or where either side's squared deviations
    sum to less than the floor."""
    a, b = col(a), col(b)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    flat = (F.var_pop(a) * n < FLOOR) | (F.var_pop(b) * n < FLOOR)
    return F.when((n < 2) | flat, 0.0).otherwise(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def percentile(c, p: float) -> Column:
    """Percentile (0 to 100) by linear interpolation between ranks, as an aggregate; 0 over no rows.

    The aggregate holds a group's distinct values in one buffer; ``percentiles`` is the way for whole large tables.
    """
    return F.coalesce(F.percentile(col(c), F.lit(p / 100.0)), F.lit(0.0))


def median(c) -> Column:
    return F.coalesce(F.median(col(c)), F.lit(0.0))


def percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """``column, q``: exact percentiles (shares of 0 to 1, linear interpolation between ranks) of whole columns; columns
    without a value have no row."""
    return long_percentiles(df.select(*[col(c).alias(c) for c in columns]).unpivot([], columns, "column", "value"), shares)


def long_percentiles(long: DataFrame, shares: list[float]) -> DataFrame:
    """The same for rows of ``column, value``.

    Equal values are counted map side and sorted over ranges of values; a range's first rank is what the ranges before
    it hold, so no column's values meet in one task.
    """
    counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialise(counts.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("column", "part").agg(F.sum("n").alias("rows"))  # a row for each task and column
    earlier = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("column", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"), F.sum("rows").over(W.partitionBy("column")).alias("total"))
    inside = F.sum("n").over(W.partitionBy("column", "part").orderBy("value"))
    ranked = ranged.withColumn("inside", inside).join(parts, ["column", "part"]).withColumn("end", F.col("earlier") + F.col("inside"))
    at = lambda rank: F.max(F.when((rank >= F.col("end") - F.col("n")) & (rank < F.col("end")), F.col("value")))
    places = [(F.col("total") - 1) * F.lit(p) for p in shares]
    found = ranked.groupBy("column").agg(F.max("total").alias("total"), *[at(f(x)).alias(f"{k}{i}") for i, x in enumerate(places) for k, f in (("a", F.floor), ("b", F.ceil))])
    between = lambda i, x: F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise((F.ceil(x) - x) * F.col(f"a{i}") + (x - F.floor(x)) * F.col(f"b{i}"))
    return found.select("column", F.array(*[between(i, x) for i, x in enumerate(places)]).alias("q"))


@dataclass(frozen=True)
class Moments:
    """Count, means and centred second moments (sums of products of deviations) of columns."""

    columns: tuple[str, ...]
    n: int
    means: np.ndarray
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.products / max(self.n - 1, 1)

    def std(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance()), 0, None))

    def correlation(self) -> np.ndarray:
        """Under two rows the identity; deviations are floored, so a constant column correlates 0 with itself."""
        if self.n < 2:
            return np.eye(len(self.columns))
        s = np.maximum(self.std(), FLOOR)
        return self.covariance() / np.outer(s, s)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a value in each of the columns."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & col(c).isNotNull()
    return df.where(keep)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """One aggregate: p means and p (p + 1) / 2 covariances, combined from partial results.

    Rows with a null in any of the columns are left out, so that all moments are of the same rows.  Beyond WIDE columns,
    whose pairs would make too many expressions, means are taken first and the products of deviations are summed by
    partition as matrices, which an aggregate adds up.
    """
    df = complete(df, columns)
    if len(columns) > WIDE:
        return _wide_moments(df, columns)
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(col(columns[i]), col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    return Moments(tuple(columns), row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))]), _products(row, pairs, len(columns)))


def _products(row, pairs, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i, j in pairs:
        out[i, j] = out[j, i] = row["n"] * (row[f"c{i}_{j}"] or 0.0)
    return out


def _wide_moments(df: DataFrame, columns: list[str]) -> Moments:
    import pandas as pd

    data = df.select(*[col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    row = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c) for c in data.columns]).first()
    means, p = np.array([v or 0.0 for v in row[1:]]), len(columns)

    def products(batches):
        total = np.zeros((p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - means
            total += x.T @ x
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    out = np.zeros((p, p))
    # p (p + 1) / 2 rows, whatever the table's size
    for r in data.mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return Moments(tuple(columns), row["n"], means, out)


def _pairwise(df: DataFrame, columns: list[str], name: str, of) -> DataFrame:
    """``feature_i, feature_j, name`` for every pair; each unordered pair is aggregated once."""
    cell = lambda a, b, v: F.struct(a.alias("feature_i"), b.alias("feature_j"), v.alias(name))
    aggs = [cell(F.lit(a), F.lit(b), of(a, b)) for a, b in combinations_with_replacement(columns, 2)]
    mirrored = F.transform(F.filter("c", lambda x: x["feature_i"] != x["feature_j"]), lambda x: cell(x["feature_j"], x["feature_i"], x[name]))
    return df.agg(F.array(*aggs).alias("c")).select(F.explode(F.concat("c", mirrored)).alias("c")).select("c.*")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature_i, feature_j, corr`` for every pair, each over the rows that have both values, from one aggregate.

    A deviation under the floor counts as the floor; under two rows with both values a column goes with itself only.
    """

    def of(a, b):
        x, y = col(a), col(b)
        deviation = lambda v, w: F.coalesce(F.stddev_samp(F.when(w.isNotNull(), v)), F.lit(0.0))
        r = F.coalesce(F.covar_samp(x, y), F.lit(0.0)) / (F.greatest(deviation(x, y), F.lit(FLOOR)) * F.greatest(deviation(y, x), F.lit(FLOOR)))
        r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))  # beyond 1 by rounding only
        return F.when(F.count(F.when(x.isNotNull(), y)) < 2, float(a == b)).otherwise(r)

    return _pairwise(df, columns, "corr", of)


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature_i, feature_j, cov`` for every pair, each over the rows that have both values; 0 under two of them."""
    return _pairwise(df, columns, "cov", lambda a, b: F.coalesce(F.covar_samp(col(a), col(b)), F.lit(0.0)))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / max(sample deviation, floor) of the columns; the others stay."""
    row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", mean), ("s", std_dev))]).first()
    return df.withColumns({c: (col(c) - F.lit(row[f"m{i}"])) / F.lit(max(row[f"s{i}"], FLOOR)) for i, c in enumerate(columns)})


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: ``column, count, mean, median, std_dev`` (population), ``min, max, q1, q3, missing, iqr, cv``.

    Columns are unpivoted once, so every column is summarised by the same aggregate; percentiles are exact.
    """
    long = df.select(*[col(c).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    rows = long.groupBy("column").agg(
        F.count("value").alias("count"),
        mean("value").alias("mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std_dev"),
        F.coalesce(F.min("value"), F.lit(0.0)).alias("min"),
        F.coalesce(F.max("value"), F.lit(0.0)).alias("max"),
    )
    # a row a column on either side
    rows = rows.join(F.broadcast(long_percentiles(long, [0.25, 0.5, 0.75])), "column", "left")
    part = lambda i: F.coalesce(F.get("q", F.lit(i)), F.lit(0.0))
    return rows.select(
        "column", "count", "mean", part(1).alias("median"), "std_dev", "min", "max", part(0).alias("q1"), part(2).alias("q3"),
        F.lit(0).cast("long").alias("missing"),
        (part(2) - part(0)).alias("iqr"),
        F.when(F.abs("mean") < FLOOR, 0.0).otherwise(F.col("std_dev") / F.abs("mean") * 100).alias("cv"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, start, end, count, frequency`` of equal-width bins, empty ones included; frequency is count / largest.

    A range under the floor gives one bin; no rows or no bins give none.
    """
    values = df.select(col(column).alias("v")).where("v IS NOT NULL")
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).where((F.col("n") > 0) & (F.lit(bins) > 0))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(max(bins, 1)))
    flat = (F.col("hi") - F.col("lo")) < FLOOR
    counted = (
        values.join(F.broadcast(bounds))  # one row
        .select(F.when(flat, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int").alias("b"))
        .groupBy("b")
        .count()
    )
    edges = bounds.select("*", F.explode(F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(max(bins - 1, 0))))).alias("bin"))
    joined = edges.join(counted, edges.bin == counted.b, "left")
    n = F.coalesce("count", F.lit(0)).cast("long")
    return joined.select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("start"),
        F.when(flat | (F.col("bin") == bins - 1), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("end"),
        n.alias("count"),
        (n / F.max(n).over(W.partitionBy())).alias("frequency"),
    )


def group_sizes(df: DataFrame, label: str, k: int) -> DataFrame:
    """``label, size`` for labels 0 to k - 1, empty ones included."""
    counts = df.groupBy(F.col(label).cast("int").alias("_l")).count()
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    return every.join(counts, every.label == counts["_l"], "left").select("label", F.coalesce("count", F.lit(0)).cast("long").alias("size"))


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    return df.select(F.col(label).alias("class")).distinct()


def correlation_insights(corr: DataFrame) -> DataFrame:
    """One row over the strict upper triangle of a correlation matrix: counts over thresholds, extremes and the mean."""
    pairs = corr.where("feature_i < feature_j")
    label = F.concat_ws("/", "feature_i", "feature_j")
    n, strong = F.count(F.lit(1)), F.count_if(F.abs("corr") > 0.7)
    return pairs.agg(
        n.alias("pairs"),
        F.max_by(label, F.struct("corr", label)).alias("most_positive"),
        F.min_by(label, F.struct("corr", label)).alias("most_negative"),
        F.count_if(F.col("corr") > 0.7).alias("strong_positive"),
        F.count_if(F.col("corr") > 0.5).alias("moderate_positive"),
        F.count_if(F.col("corr") < -0.7).alias("strong_negative"),
        (strong > F.expr("count(1) div 2")).alias("multicollinear"),
        (strong == 0).alias("independent"),
        F.avg(F.abs("corr")).alias("mean_abs"),
    )


def dataset_tips(corr: DataFrame, n_samples: int, n_features: int) -> list[str]:
    strong = corr.where("feature_i < feature_j AND abs(corr) > 0.7").count()
    tips = [f"{strong} feature pairs are strongly correlated"] * (strong > 0)
    tips += ["More than 10 features: consider reducing them"] * (n_features > 10)
    return tips + ["Fewer than 10 samples for each feature"] * (n_features > 0 and n_samples / n_features < 10)


def cost_reduction(history: DataFrame, order: str = "iter", cost: str = "cost") -> DataFrame:
    """Percent by which the cost fell from first to last, within 0 and 99.99; under two entries 0."""
    first, last = F.min_by(cost, order), F.max_by(cost, order)
    pct = F.greatest(F.lit(0.0), F.least(F.lit(99.99), (first - last) / F.nullif(first, F.lit(0.0)) * 100))
    return history.agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.coalesce(pct, F.lit(0.0))).alias("reduction_pct"))


def path_lengths(paths: DataFrame, by: str, order: str) -> DataFrame:
    """Length of each path, its end's distance from a target (tx, ty), and a band for that distance."""
    w = W.partitionBy(by).orderBy(order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    far = F.hypot(F.max_by(F.col("x") - F.col("tx"), order), F.max_by(F.col("y") - F.col("ty"), order))
    out = paths.withColumn("_step", step).groupBy(by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), far.alias("distance"))
    return out.withColumn("quality", F.when(F.col("distance") < 0.01, "excellent").when(F.col("distance") < 0.1, "good").when(F.col("distance") < 0.5, "fair").otherwise("poor"))
