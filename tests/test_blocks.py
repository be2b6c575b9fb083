import numpy as np
import pytest

from granary.errors import DimensionMismatch
from granary.operators import blocks as B


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(3)


def dense(m):
    out = np.zeros(m.shape)
    for r in m.coordinates().collect():
        out[r.i, r.j] = r.v
    return out


@pytest.mark.parametrize(("n", "k", "m", "size"), [(37, 5, 23, 4), (3, 50, 2, 4), (20, 20, 20, 3), (7, 7, 7, 128)])
def test_products(spark, n, k, m, size):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    a, b = B.from_packed(table(spark, x), size), B.from_packed(table(spark, y), size)
    assert a.grid() == (-(-n // size), -(-k // size)) and a.blocks.count() == np.prod(a.grid())
    out = a.times(b)
    assert out.shape == (n, m) and out.blocks.count() == np.prod(out.grid()) and np.allclose(dense(out), x @ y)
    assert np.allclose(dense(a.transpose()), x.T)
    assert np.allclose([r.features for r in out.packed().orderBy("row_id").collect()], x @ y)


def test_gram_and_sparse_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(101, 9))
    a = B.from_packed(table(spark, x), 8)
    assert np.allclose(dense(a.transpose().times(a)), x.T @ x)
    cells = spark.createDataFrame([(0, 0, 2.0), (8, 20, -1.0)], "i int, j int, v double")
    s = B.from_coordinates(cells, 9, 21, 8)
    y = np.zeros((9, 21))
    y[0, 0], y[8, 20] = 2, -1
    assert s.blocks.count() == 2 and np.allclose(dense(a.times(s)), x @ y)
    assert np.allclose([r.features for r in s.packed().orderBy("row_id").collect()], y[[*range(9)]])


def test_sizes_that_do_not_fit(spark):
    a = B.from_packed(table(spark, np.ones((3, 2))), 2)
    with pytest.raises(DimensionMismatch):
        a.times(a)
    with pytest.raises(DimensionMismatch):
        a.times(B.from_packed(table(spark, np.ones((2, 2))), 4))
    for rows in ([(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(DimensionMismatch):
            B.from_packed(spark.createDataFrame(rows, "row_id long, features array<double>"))
    with pytest.raises(DimensionMismatch):
        B.from_coordinates(spark.createDataFrame([(3, 0, 1.0)], "i int, j int, v double"), 3, 1)
    none = B.from_packed(spark.createDataFrame([], "row_id long, features array<double>"))
    assert none.shape == (0, 0) and none.blocks.count() == 0
