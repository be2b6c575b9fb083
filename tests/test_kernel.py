import numpy as np
import pytest

from granary.errors import EmptyData, InvalidParameter, NotFitted
from granary.plans import kernel as K


def table(spark, x):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>").repartition(3)


def full(x, kernel, gamma, k):
    """Kernel PCA over all rows: coordinates along the k largest components, and variances."""
    g = K.KERNELS[kernel](x, x, gamma)
    c = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(c @ g @ c)
    return vectors[:, ::-1][:, :k] * np.sqrt(values[::-1][:k]), values[::-1][:k] / len(x)


@pytest.mark.parametrize("kernel", ["rbf", "polynomial", "linear"])
def test_equals_kernel_pca_if_all_rows_are_landmarks(spark, kernel):
    x = np.random.default_rng(1).normal(size=(40, 3))
    model = K.KernelPCA(3, kernel, 0.3, landmarks=100).fit(table(spark, x))
    want, variance = full(x, kernel, 0.3, 3)
    got = np.array([r.projected for r in model.transform(table(spark, x)).orderBy("row_id").collect()])
    assert np.allclose(model.explained_variance, variance, rtol=1e-6)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-6)


def test_landmarks_come_near_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in (-1, 1)])
    model = K.KernelPCA(2, gamma=0.5, landmarks=40).fit(table(spark, [*x, None]))
    assert len(model.points) == 40 and np.allclose(model.explained_variance, full(x, "rbf", 0.5, 2)[1], rtol=0.02)
    odd = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, None, "b"), (2, [1.0, None], "c"), (3, [1.0], "d")], "row_id long, features array<double>, projected string")
    out = model.transform(odd).orderBy("row_id").collect()
    assert [r.projected is None for r in out] == [False, True, True, True] and out[1].features is None
    with pytest.raises(EmptyData):
        model.fit(odd.limit(0))
    with pytest.raises(NotFitted):
        K.KernelPCA(2).transform(odd)
    with pytest.raises(InvalidParameter):
        K.KernelPCA(2, "none")
