import numpy as np
import pytest

from granary.errors import DimensionMismatch, InvalidParameter
from granary.plans import density as D


def table(spark, x):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(3)


def brute(x, eps, least):
    x = np.asarray(x, dtype=float)
    near = [[j for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps * eps] for i in range(len(x))]
    core = [len(n) >= least for n in near]
    label = [-1] * len(x)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = i
                        todo.append(j)
    out = []
    for i in range(len(x)):
        mine = [label[j] for j in near[i] if core[j]]
        out.append((i, label[i], "core") if core[i] else (i, min(mine), "border") if mine else (i, -1, "noise"))
    return out


def found(spark, x, eps, least):
    return sorted(map(tuple, D.Density(eps, least).fit_predict(table(spark, x)).collect()))


@pytest.mark.parametrize(("dims", "limit"), [(1, 256), (2, 256), (2, 3), (3, 5)])
def test_equals_brute_force(spark, monkeypatch, dims, limit):
    monkeypatch.setattr(D, "LIMIT", limit)
    rng = np.random.default_rng(dims + limit)
    blobs = [rng.normal(c, 0.12, (45, dims)) for c in rng.uniform(-2, 2, (4, dims))]
    x = np.vstack([*blobs, rng.uniform(-3, 3, (60, dims))])
    x = np.vstack([x, x[:12], x[:3]])  # repeated vectors
    kinds = set()
    for eps, least in ((0.15, 4), (0.4, 9)):
        want = brute(x, eps, least)
        assert found(spark, x, eps, least) == want
        kinds |= {k for _, _, k in want}
    assert kinds == {"core", "border", "noise"}


def test_two_crowds_that_nearly_touch(spark, monkeypatch):
    """Both sides are far over the limit; the nearest two points decide."""
    monkeypatch.setattr(D, "LIMIT", 4)
    rng = np.random.default_rng(5)
    for gap in (0.999, 1.001):
        a = np.c_[-rng.uniform(0, 0.5, 80), rng.uniform(0, 0.5, 80)]
        b = np.c_[gap + rng.uniform(0.01, 0.5, 80), rng.uniform(0, 0.5, 80)]
        x = np.vstack([a, b, [[0.0, 0.25], [gap, 0.25]]])
        got = found(spark, x, 1.0, 5)
        assert got == brute(x, 1.0, 5) and len({c for _, c, _ in got}) == (1 if gap < 1 else 2)


def test_odd_rows(spark):
    x = [[0, 0], [-0.0, 0], [0.1, 0], None, [], [float("nan"), 1], [9, 9], [float("inf"), 0]]
    assert found(spark, x, 0.5, 3) == [(0, 0, "core"), (1, 0, "core"), (2, 0, "core"), *[(i, -1, "noise") for i in range(3, 8)]]
    odd = table(spark, x).selectExpr("row_id", "features", "1 AS cell", "2 AS pid", "3 AS kind", "4 AS x")
    assert D.Density(0.5, 3).fit_predict(odd).columns == ["row_id", "cluster", "kind"]
    assert D.Density(1, 1).fit_predict(table(spark, [])).count() == 0
    none = spark.createDataFrame([(None, [0.0])], "row_id long, features array<double>")
    assert [tuple(r) for r in D.Density(1, 1).fit_predict(none).collect()] == [(None, -1, "noise")]
    with pytest.raises(DimensionMismatch):
        D.Density(1, 1).fit_predict(table(spark, [[1], [1, 2]]))
    with pytest.raises(InvalidParameter):
        D.Density(1, 1).fit_predict(table(spark, [[1] * 5]))
    with pytest.raises(InvalidParameter):
        D.Density(0, 1)
