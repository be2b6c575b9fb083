import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import base
from granary.errors import InvalidParameter
from granary.functions import basic
from granary.operators.stats import moments
from granary.plans import kmeans, linear, logistic, pca, selection


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ [2.0, 0.0, -1.0] + 3 + rng.normal(size=300) * 0.1
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double"), x, y


def test_split_is_stable(data):
    df, _, _ = data
    a, b = selection.train_test_split(df, "id", 0.3)
    ids = {r.id for r in b.collect()}
    assert ids == {r.id for r in selection.train_test_split(df.repartition(7), "id", 0.3)[1].collect()} and a.count() + len(ids) == 300 and 60 < len(ids) < 120
    with pytest.raises(InvalidParameter):
        selection.train_test_split(df, "id", 1.5)


def test_ridge_and_lasso(data):
    df, x, y = data
    m = moments(df, ["a", "b", "c", "y"])
    xc, yc = x - x.mean(0), y - y.mean()
    w, b = selection.ridge(m, 0.5)
    assert np.allclose(w, np.linalg.solve(xc.T @ xc / 300 + 0.5 * np.eye(3), xc.T @ yc / 300)) and b == pytest.approx(y.mean() - w @ x.mean(0))
    w, _ = selection.lasso(m, 0.3)
    assert w[1] == 0 and w[0] > 1.2 and w[2] < -0.5
    g = xc.T @ (yc - xc @ w) / 300
    assert np.allclose(g[[0, 2]], 0.3 * np.sign(w[[0, 2]]), atol=1e-6) and abs(g[1]) <= 0.3 + 1e-9


def test_cross_validation_equals_refitting(data):
    df, x, y = data
    s = selection.cross_validate(df, ["a", "b", "c"], "y", "id", [0.0, 0.01, 1.0], k=4)
    folds = np.array([r.f for r in df.orderBy("id").select(selection.fold(F.col("id"), 4).alias("f")).collect()])
    errors = []
    for f in range(4):
        tr, te = folds != f, folds == f
        a = np.c_[x[tr], np.ones(tr.sum())]
        theta = np.linalg.lstsq(a, y[tr], rcond=None)[0]
        errors.append((te.sum(), ((np.c_[x[te], np.ones(te.sum())] @ theta - y[te]) ** 2).mean()))
    assert s.table[0][1] == pytest.approx(np.average([e for _, e in errors], weights=[n for n, _ in errors]))
    assert s.best in (0.0, 0.01) and s.model.predict(df).count() == 300 and selection.cross_validate(df, ["a"], "y", "id", [0.1], kind="lasso").best == 0.1


def test_mape_polynomial_and_endpoints(spark, data):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 5.0), (4.0, 5.0)], "y double, p double")
    assert df.agg(selection.mape("y", "p")).first()[0] == pytest.approx(37.5)
    out, names = selection.polynomial(df, ["y", "p"], 2)
    assert names == ["y", "p", "y*y", "y*p", "p*p"] and out.select("`y*p`").first()[0] == 2.0
    m = linear.LinearRegression(features=["y"], weights=np.array([2.0]), bias=1.0)
    r = linear.endpoints(df, m, "y", "p").first()
    assert (r.x_min, r.x_max, r.y_at_x_min) == (pytest.approx(-0.4), pytest.approx(4.4), pytest.approx(0.2))
    assert spark.range(1).select(basic.add(F.lit(2), F.lit(3)), basic.sum_as_string(F.lit(2), F.lit(3))).first()[:] == (5, "5")


def test_protocols():
    assert isinstance(linear.LinearRegression(), base.SupervisedModel) and isinstance(logistic.LogisticRegression(), base.SupervisedModel)
    assert isinstance(kmeans.KMeans(2), base.Clusterer) and isinstance(pca.PCA(1), base.UnsupervisedModel)
