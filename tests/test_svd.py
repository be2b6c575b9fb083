import numpy as np
import pytest

from granary.errors import DimensionMismatch, EmptyData, InvalidParameter, NotFitted
from granary.plans import svd as S


def table(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(parts)


def aligned(a, b):
    return np.allclose(np.abs(np.sum(a * b, axis=1)), 1, atol=1e-6)


def test_tall_equals_numpy_and_keeps_small_values(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    monkeypatch.setattr(S, "BRANCHES", 2)
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(200, 5)))
    x = q * [1e3, 1.0, 1e-3, 1e-6, 1e-9] @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    model = S.SVD(5).fit(table(spark, x, 9))
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s, rtol=1e-3, atol=1e-12) and np.allclose(model.values[:4], s[:4], rtol=1e-6)
    assert aligned(model.vectors[:4], v[:4])
    rows = {r.row_id: r.projected for r in model.transform(table(spark, x)).collect()}
    assert np.allclose(np.array([rows[i] for i in range(200)]) @ model.vectors, x)


def test_sketch_of_a_wide_table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 150)) + 1e-4 * rng.normal(size=(80, 150))
    model = S.SVD(4, sketch=True, seed=3).fit(table(spark, x))
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.values, s[:4], rtol=1e-6) and aligned(model.vectors, v[:4])
    again = S.SVD(4, sketch=True, seed=3).fit(table(spark, x, 1))
    assert np.allclose(again.values, model.values) and aligned(again.vectors, model.vectors)


def test_odd_tables(spark):
    few = S.SVD(9).fit(table(spark, [[3, 0, 0], [0, 2, 0]]))
    assert np.allclose(few.values, [3, 2]) and few.table(spark).count() == 2
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [0.0, 2.0])], "row_id long, features array<double>")
    assert np.allclose(S.SVD(2).fit(rows).values, [2, 1])
    assert [r.projected is None for r in S.SVD(2).fit(rows).transform(rows).orderBy("row_id").collect()] == [False, True, True, False]
    assert np.allclose(S.SVD(2, sketch=True).fit(table(spark, [[1, 1], [1, 1], [1, 1]])).values, [6**0.5, 0], atol=1e-9)
    with pytest.raises(EmptyData):
        S.SVD(1).fit(rows.limit(0))
    with pytest.raises(DimensionMismatch):
        S.SVD(1).fit(table(spark, [[1], [1, 2]]))
    with pytest.raises(InvalidParameter):
        S.SVD(0)
    with pytest.raises(NotFitted):
        S.SVD(1).transform(rows)
