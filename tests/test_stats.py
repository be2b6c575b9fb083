import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import stats as S


def frame(spark, rows, names="x double, y double"):
    return spark.createDataFrame(rows, names)


def test_golden_values(spark):
    df = frame(spark, [(float(v),) for v in (2, 4, 4, 4, 5, 5, 7, 9)], "x double")
    mean, var, sd = df.agg(S.mean("x"), S.variance("x"), S.std_dev("x")).first()
    assert (mean, round(var, 6), round(sd, 6)) == (5.0, 4.571429, 2.13809)
    empty = df.where("false").agg(S.mean("x"), S.variance("x"), S.percentile("x", 50), S.median("x")).first()
    assert tuple(empty) == (0.0,) * 4
    assert df.limit(1).agg(S.variance("x")).first()[0] == 0.0


def test_pearson(spark):
    r = lambda rows: frame(spark, rows).agg(S.pearson("x", "y")).first()[0]
    assert r([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]) == pytest.approx(1)
    assert r([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)]) == pytest.approx(-1)
    assert r([(1.0, 5.0), (2.0, 5.0)]) == 0.0 and r([(1.0, 1.0)]) == 0.0


def test_correlation_matrix(spark):
    df = frame(spark, [(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.0, 7.0)], "a double, b double, c double")
    got = {(r.feature_i, r.feature_j): r["corr"] for r in S.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1) and got["c", "c"] == 0.0 and got["a", "c"] == 0.0
    m = S.moments(df, ["a", "b", "c"])
    assert np.allclose(m.correlation(), [[1, 1, 0], [1, 1, 0], [0, 0, 0]])
    one = S.correlation_matrix(df.limit(1), ["a", "b"]).collect()
    assert {(r.feature_i, r.feature_j): r["corr"] for r in one} == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def test_moments_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 1.5 + 1e6).alias("x"), F.sin("id").alias("y"))
    a, b = S.moments(df.repartition(1), ["x", "y"]), S.moments(df.repartition(8), ["x", "y"])
    assert np.allclose(a.products, b.products) and np.allclose(a.means, b.means)
    assert np.allclose(a.covariance(), np.cov(np.array(df.collect()).T))


def test_standardize(spark):
    rows = S.standardize(frame(spark, [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]), ["x", "y"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, -1.0), (0.0, 0.0), (1.0, 1.0)]


def test_column_stats_and_percentiles(spark):
    df = frame(spark, [(float(i),) for i in range(1, 6)], "x double")
    assert [df.agg(S.percentile("x", p)).first()[0] for p in (0, 50, 100)] == [1, 3, 5]
    r = S.column_stats(df, ["x"]).first()
    assert (r["count"], r["mean"], r["median"], r["q1"], r["q3"], r["iqr"], r["missing"]) == (5, 3.0, 3.0, 2.0, 4.0, 2.0, 0)
    assert r["std_dev"] == pytest.approx(math.sqrt(2))


def test_histogram(spark):
    df = frame(spark, [(float(i),) for i in range(1, 11)], "x double")
    rows = S.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2] * 5 and rows[-1]["end"] == 10.0 and all(r["frequency"] == 1 for r in rows)
    gaps = S.histogram(frame(spark, [(0.0,), (0.1,), (10.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in gaps] == [2, 0, 0, 1]
    assert [tuple(r)[3:] for r in S.histogram(frame(spark, [(3.0,)] * 4, "x double"), "x", 5).collect()] == [(4, 1.0)]
    assert S.histogram(df.where("false"), "x", 5).count() == 0 and S.histogram(df, "x", 0).count() == 0


def test_groups_costs_and_paths(spark):
    assert {r.label: r["size"] for r in S.group_sizes(frame(spark, [(0,), (0,), (2,)], "l int"), "l", 4).collect()} == {0: 2, 1: 0, 2: 1, 3: 0}
    h = frame(spark, [(0, 100.0), (1, 40.0)], "iter int, cost double")
    assert S.cost_reduction(h).first()[0] == 60.0 and S.cost_reduction(h.limit(1)).first()[0] == 0.0
    p = frame(spark, [("a", 0, 0.0, 0.0, 3.0, 4.0), ("a", 1, 3.0, 4.0, 3.0, 4.0)], "o string, i int, x double, y double, tx double, ty double")
    assert tuple(S.path_lengths(p, "o", "i").first()) == ("a", 5.0, 0.0, "excellent")


def test_insights(spark):
    df = frame(spark, [(1.0, 2.0, -1.0), (2.0, 4.1, -2.0), (3.0, 6.0, -3.2)], "a double, b double, c double")
    corr = S.correlation_matrix(df, ["a", "b", "c"])
    r = S.correlation_insights(corr).first()
    assert (r.pairs, r.most_positive, r.strong_positive, r.strong_negative, r.multicollinear) == (3, "a/b", 1, 2, True)
    assert len(S.dataset_tips(corr, 3, 3)) == 2


def test_wide_moments_equal_narrow_ones(spark, monkeypatch):
    df = spark.range(500).select(F.sin("id").alias("a"), (F.col("id") * 2.0).alias("b"), F.cos("id").alias("c")).repartition(5)
    narrow = S.moments(df, ["a", "b", "c"])
    monkeypatch.setattr(S, "WIDE", 2)
    wide = S.moments(df, ["a", "b", "c"])
    assert wide.n == narrow.n and np.allclose(wide.means, narrow.means) and np.allclose(wide.products, narrow.products)
    assert S.moments(df.where("false"), ["a", "b", "c"]).n == 0


def test_percentiles_of_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=500), "b": rng.integers(0, 7, 500).astype(float), "c": np.full(500, 2.5), "one": np.r_[4.0, np.full(499, np.nan)], "none": np.full(500, np.nan)}
    rows = [tuple(None if np.isnan(v[i]) else float(v[i]) for v in data.values()) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {r["column"]: r["q"] for r in S.percentiles(df, list(data), shares).collect()}
    assert set(found) == {"a", "b", "c", "one"}
    for c, q in found.items():
        assert np.allclose(q, np.quantile(data[c][~np.isnan(data[c])], shares))


def test_moments_are_of_complete_rows_at_any_width(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 17))
    holes = rng.random((60, 17)) < 0.02
    df = spark.createDataFrame([tuple(None if h else float(v) for v, h in zip(*r)) for r in zip(x, holes)], ", ".join(f"c{i} double" for i in range(17)))
    whole = x[~holes.any(axis=1)]
    m = S.moments(df, [f"c{i}" for i in range(17)])
    assert m.n == len(whole) < 60 and np.allclose(m.covariance(), np.cov(whole.T)) and np.allclose(m.means, whole.mean(axis=0))
    few = S.moments(df.where("c16 IS NOT NULL"), [f"c{i}" for i in range(16)])
    assert few.n == m.n and np.allclose(few.products, m.products[:16, :16])


def test_correlations_with_nulls_are_of_the_rows_with_both(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)] + [(2.0, None)] * 20
    df = spark.createDataFrame(rows, "a double, b double")
    assert df.agg(S.pearson("a", "b")).first()[0] == pytest.approx(1)
    assert {(r.feature_i, r.feature_j): r["corr"] for r in S.correlation_matrix(df, ["a", "b"]).collect()} == pytest.approx({(x, y): 1.0 for x in "ab" for y in "ab"})
    none = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 4.0)], "a double, b double")
    assert none.agg(S.pearson("a", "b")).first()[0] == 0
    assert {(r.feature_i, r.feature_j): r["corr"] for r in S.correlation_matrix(none, ["a", "b"]).collect()}["a", "b"] == 0


def test_correlations_lie_between_minus_one_and_one(spark):
    import random

    for seed in range(5):
        rng = random.Random(seed)
        cell = lambda: None if rng.random() < 0.4 else rng.choice([0.0, 1.0, 1e-9, 1e9, rng.gauss(0, 1)])
        df = spark.createDataFrame([tuple(cell() for _ in range(3)) for _ in range(rng.randrange(2, 30))], "a double, b double, c double")
        found = S.correlation_matrix(df, ["a", "b", "c"])
        assert all(abs(r["corr"]) <= 1 + 1e-12 for r in found.collect())
        assert all(abs(x) <= 1 + 1e-12 for x in df.agg(S.pearson("a", "b"), S.pearson("b", "c")).first())
